"""Candidate prices of each product and the best one when no budget binds.

A pricing problem is one row per product, money in whole cents:
sku, category, cost_c, current_c, stock, elasticity, reference_c, base_demand.
The candidate grid stays inside its row as an array, so that scoring needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.functions import demand as D
from pricemill.functions import guardrails as G
from pricemill.functions.money import cents, whole_div
from pricemill.params import DEFAULT_POLICY, Policy


def pricing_problems(rows: DataFrame) -> DataFrame:
    """Problem rows from prices in currency units.

    Reads sku, category, cost, current_price, stock, elasticity and, where present,
    reference_price and base_demand. A null or zero reference means the current price.
    """
    current = cents(F.col("current_price"))
    reference, base = current, F.lit(1.0)
    if "reference_price" in rows.columns:
        reference = D.value_or(cents(F.col("reference_price")), current)
    if "base_demand" in rows.columns:
        base = F.coalesce(F.col("base_demand").cast("double"), F.lit(1.0))
    return rows.select(
        "sku",
        "category",
        cents(F.col("cost")).alias("cost_c"),
        current.alias("current_c"),
        F.col("stock").cast("long").alias("stock"),
        F.col("elasticity").cast("double").alias("elasticity"),
        reference.alias("reference_c"),
        base.alias("base_demand"),
    )


def with_bounds(problems: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Adds the feasible price range; the margin floor wins when the limits conflict."""
    floor = G.margin_floor_price(F.col("cost_c"), policy)
    down, up = G.change_limits(F.col("current_c"), policy)
    no_raise = F.col("stock") <= policy.low_stock_units
    high = F.when(no_raise, F.least(up, F.col("current_c"))).otherwise(up)
    ranged = problems.withColumns(
        {"_floor": floor, "_low": F.greatest(down, floor), "_high": high}
    )
    conflict = F.col("_low") > F.col("_high")
    return ranged.withColumns(
        {
            "low_c": F.when(conflict, F.col("_floor")).otherwise(F.col("_low")),
            "high_c": F.when(conflict, F.col("_floor")).otherwise(F.col("_high")),
        }
    ).drop("_floor", "_low", "_high")


def price_grid(low: Column, high: Column, points: int) -> Column:
    """Ascending distinct prices, evenly spread from low to high, in whole cents."""
    if points < 2:
        raise ValueError("a price grid needs at least two points")
    gaps = points - 1
    steps = F.sequence(F.lit(0), F.lit(gaps))
    return F.array_distinct(
        F.transform(
            steps, lambda i: low + whole_div(F.lit(2) * (high - low) * i + gaps, 2 * gaps)
        )
    )


def _with_units(price: Column) -> Column:
    wanted = D.linear_demand(
        price, F.col("reference_c"), F.col("elasticity"), F.col("base_demand")
    )
    return F.struct(
        price.alias("price_c"), D.capped_units(wanted, F.col("stock")).alias("units")
    )


def _with_value(c: Column, objective: str) -> Column:
    return F.struct(
        c["price_c"].alias("price_c"),
        c["units"].alias("units"),
        D.candidate_value(c["price_c"], F.col("cost_c"), c["units"], objective).alias("value"),
        D.discount_spend(F.col("current_c"), c["price_c"], c["units"]).alias("spend"),
    )


def with_candidates(problems: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Adds `candidates`: array of (price_c, units, value, spend)."""
    grid = price_grid(F.col("low_c"), F.col("high_c"), policy.grid_points)
    scored = F.transform(
        F.transform(grid, _with_units), lambda c: _with_value(c, policy.objective)
    )
    return with_bounds(problems, policy).withColumn("candidates", scored)


def best_candidate(candidates: Column, current: Column) -> Column:
    """Highest value; ties go to the price nearest the current one, then to the lower."""
    ranked = F.transform(
        candidates,
        lambda c: F.struct(
            c["value"].alias("value"),
            (-F.abs(c["price_c"] - current)).alias("near"),
            (-c["price_c"]).alias("low"),
            c["spend"].alias("spend"),
        ),
    )
    return F.array_max(ranked)


def price_candidates(problems: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """One row per (product, candidate price).

    A grid is never empty. The outer form spares the emptiness filter that Spark would add, and
    with it a second evaluation of the grid.
    """
    return with_candidates(problems, policy).select(
        "sku", "category", F.inline_outer("candidates")
    )


def optimum_prices(problems: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Best candidate per product with no budget."""
    best = with_candidates(problems, policy).withColumn(
        "_best", best_candidate(F.col("candidates"), F.col("current_c"))
    )
    return best.select(
        "sku",
        "category",
        "current_c",
        (-F.col("_best.low")).alias("price_c"),
        F.col("_best.value").alias("value"),
        F.col("_best.spend").alias("spend"),
    )
