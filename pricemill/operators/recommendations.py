"""From chosen prices to recommendations: joint pricing, suggestions, sanity rejection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill import schemas
from pricemill.functions import guardrails as G
from pricemill.functions.demand import value_or
from pricemill.functions.money import cents, from_cents
from pricemill.operators.candidates import pricing_problems
from pricemill.operators.optimizer import JointPrices, optimize_prices
from pricemill.params import DEFAULT_POLICY, Policy
from pricemill.session import staged
from pricemill.sources.reference_data import with_elasticity

JOINT_REASON = "Joint price for category %s: most profit within budget, margin and stock limits."
FALLBACK_REASON = "Rule: no usable suggestion, matched to the competitor average."


class Recommended(NamedTuple):
    accepted: DataFrame  # recommendation columns
    rejected: DataFrame  # recommendation columns and reason
    joint: JointPrices | None = None


def flagged_groups(analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flagged SKUs of categories with two or more of them, and those that stand alone.

    Counts are aggregated, written (one row per category, so that their size is known to the
    join) and joined back; a window by category would gather it in one task.
    """
    flagged = analysis.filter("needs_decision")
    sizes = flagged.groupBy("category").agg(F.count(F.lit(1)).alias("flagged_in_category"))
    counted = flagged.join(staged(sizes, "flagged"), "category")
    together = counted.filter("flagged_in_category >= 2")
    return together, counted.filter("flagged_in_category < 2")


def _assemble(rows: DataFrame, policy: Policy) -> DataFrame:
    """Recommendation columns from rows with cents: current_c, price_c, cost_c and stock."""
    cur, p, cost = F.col("current_c"), F.col("price_c"), F.col("cost_c")
    return rows.select(
        "sku",
        from_cents(cur).alias("current_price"),
        from_cents(p).alias("recommended_price"),
        "confidence",
        "reasoning",
        G.projected_margin(p, cost).alias("projected_margin_pct"),
        F.when(F.col("source") == "optimizer", True)
        .otherwise(G.is_reversible(cur, p, policy))
        .alias("reversible"),
        G.first_violation(cur, p, cost, F.col("stock"), policy).alias("guardrail_violation"),
        "source",
        G.within_max_change(cur, p, policy).alias("_sane"),
    )


def reject_insane(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that move more than the allowed change are set aside with a reason, not lost."""
    accepted = rows.filter("_sane").drop("_sane")
    rejected = rows.filter("NOT _sane").drop("_sane")
    return accepted, rejected.withColumn("reason", F.lit("change_exceeds_maximum"))


def joint_problems(
    together: DataFrame, elasticity: DataFrame, policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Pricing problems of the flagged SKUs that share a category, from their analysis rows."""
    rows = with_elasticity(together, elasticity, policy).select(
        "sku",
        "category",
        "cost",
        F.col("our_price").alias("current_price"),
        "stock",
        "elasticity",
        F.col("avg_competitor_price").alias("reference_price"),
    )
    return pricing_problems(rows)


def recommend_jointly(
    together: DataFrame, elasticity: DataFrame, policy: Policy = DEFAULT_POLICY
) -> Recommended:
    """Recommendations for flagged SKUs that share a category, from their analysis rows."""
    joint = optimize_prices(joint_problems(together, elasticity, policy), policy=policy)
    facts = joint.problems.select("sku", "category", "cost_c", "current_c", "stock")
    rows = joint.prices.select("sku", "price_c").join(facts, "sku").withColumns(
        {
            "confidence": G.optimizer_confidence(F.col("current_c"), F.col("price_c"), policy),
            "reasoning": F.format_string(JOINT_REASON, "category"),
            "source": F.lit("optimizer"),
        }
    )
    accepted, rejected = reject_insane(_assemble(rows, policy))
    unpriced = joint.rejected.select(
        "sku",
        from_cents(F.col("current_c")).alias("current_price"),
        *[
            F.lit(None).cast(f.dataType).alias(f.name)
            for f in schemas.RECOMMENDATIONS.fields
            if f.name not in ("sku", "current_price", "source")
        ],
        F.lit("optimizer").alias("source"),
        "reason",
    )
    return Recommended(accepted, rejected.unionByName(unpriced), joint)


def recommend_from_suggestions(
    single: DataFrame, suggestions: DataFrame, policy: Policy = DEFAULT_POLICY
) -> Recommended:
    """Recommendations for SKUs that stand alone, from suggestions that came from outside.

    A missing or invalid suggestion falls back to the market average, else the own price.
    """
    schemas.require(suggestions, schemas.SUGGESTIONS, "suggestions")
    usable = suggestions.filter(
        (F.col("recommended_price") >= policy.min_suggested_price)
        & F.col("confidence").between(0.0, 1.0)
    ).select(
        "sku",
        cents(F.col("recommended_price")).alias("_suggested"),
        F.col("confidence").alias("_confidence"),
        F.col("reasoning").alias("_reasoning"),
    )
    current = cents(F.col("our_price"))
    rule_price = value_or(cents(F.col("avg_competitor_price")), current)
    has = F.col("_suggested").isNotNull()
    rows = single.join(usable, "sku", "left").select(
        "sku",
        "stock",
        current.alias("current_c"),
        cents(F.col("cost")).alias("cost_c"),
        F.coalesce("_suggested", rule_price).alias("price_c"),
        F.when(has, F.col("_confidence"))
        .otherwise(F.lit(policy.fallback_confidence))
        .alias("confidence"),
        F.when(has, F.col("_reasoning")).otherwise(F.lit(FALLBACK_REASON)).alias("reasoning"),
        F.lit("llm").alias("source"),
    )
    return Recommended(*reject_insane(_assemble(rows, policy)))


def with_market_context(recommendations: DataFrame, analysis: DataFrame) -> DataFrame:
    """Adds the competitor range and trend that the run metrics test prices against."""
    context = analysis.select(
        "sku", "min_competitor_price", "max_competitor_price", "avg_competitor_trend_pct"
    )
    return recommendations.join(context, "sku", "left")
