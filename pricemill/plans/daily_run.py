"""The daily pricing run over whole tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemill import schemas
from pricemill.operators.approval import execute, resolve_answers, route, to_queue
from pricemill.operators.market import analyze_market
from pricemill.operators.metrics import run_metrics
from pricemill.operators.recommendations import (
    flagged_groups,
    recommend_from_suggestions,
    recommend_jointly,
    with_market_context,
)
from pricemill.params import DEFAULT_POLICY, Policy
from pricemill.session import staged
from pricemill.sources.audit_log import append_events, as_events
from pricemill.sources.snapshots import apply_prices


class PricingRun(NamedTuple):
    analysis: DataFrame
    recommendations: DataFrame
    rejected: DataFrame
    results: DataFrame
    queue: DataFrame
    new_catalog: DataFrame
    context: DataFrame
    summary: DataFrame


def no_suggestions(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], schemas.SUGGESTIONS)


def run_summary(
    catalog: DataFrame, prices: DataFrame, analysis: DataFrame, results: DataFrame, run_id: str
) -> DataFrame:
    """One row of counts per stage, from one-row aggregates."""
    found = catalog.join(prices.select("sku"), "sku", "left_semi")
    parts = [
        catalog.agg(F.count(F.lit(1)).alias("skus_requested")),
        found.agg(F.count(F.lit(1)).alias("skus_found")),
        analysis.agg(F.count_if("needs_decision").alias("flagged")),
        results.agg(
            F.count(F.lit(1)).alias("recommendations"),
            F.count_if("executed").alias("executed"),
            F.count_if(F.col("outcome") == "queued_for_review").alias("queued_for_review"),
        ),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.agg(
        F.lit(run_id).alias("run_id"), *[F.max(c).alias(c) for c in whole.columns]
    )


def pricing_run(
    catalog: DataFrame,
    prices: DataFrame,
    elasticity: DataFrame,
    suggestions: DataFrame | None = None,
    run_id: str = "run",
    policy: Policy = DEFAULT_POLICY,
) -> PricingRun:
    """Lazy frames of one run: analysis, recommendations, routing, execution and summary.

    The analysis and the recommendations are written once, since several outputs read them.
    """
    analysis = staged(analyze_market(catalog, prices, policy), "analysis")
    together, single = flagged_groups(analysis)
    joint = recommend_jointly(together, elasticity, policy)
    alone = recommend_from_suggestions(
        single, suggestions if suggestions is not None else no_suggestions(catalog), policy
    )
    recommendations = staged(joint.accepted.unionByName(alone.accepted), "recommended")
    routed = route(recommendations, policy)
    results = execute(routed)
    return PricingRun(
        analysis=analysis,
        recommendations=recommendations,
        rejected=joint.rejected.unionByName(alone.rejected),
        results=results,
        queue=to_queue(routed, run_id),
        new_catalog=apply_prices(catalog, results.filter("executed")),
        context=with_market_context(recommendations, analysis),
        summary=run_summary(catalog, prices, analysis, results, run_id),
    )


def settle_queue(
    queue: DataFrame, decisions: DataFrame, policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Execution results of queued rows once the answers are in."""
    return execute(resolve_answers(queue, decisions, policy))


# Recommendations per logged batch event: keeps one JSON line to a bounded size.
LOG_BATCH = 1000


def in_log_order(rows: DataFrame, key: str = "sku") -> DataFrame:
    """Adds `position` from 0 in the order of `key`: ranges sorted each, then one offset per range.

    The rows are written once, so that places do not change when an executor is lost.
    """
    ranged = rows.repartitionByRange(key).sortWithinPartitions(key)
    # the id counts from 0 in each range, below the range's number
    own = staged(ranged.withColumn("_at", F.monotonically_increasing_id()), "log-order")
    own = own.withColumn("_range", F.shiftright("_at", 33))
    ranges = own.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range, as many as the session has shuffle partitions
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        own.join(ranges.select("_range", before.alias("_before")), "_range")
        .withColumn("position", place)
        .drop("_at", "_range", "_before")
    )


def decision_events(context: DataFrame, run_id: str) -> DataFrame:
    """Recommendations in order of SKU with their market context, as numbered batch events of bounded size."""
    fields = [f.name for f in schemas.LOGGED_RECOMMENDATION.fields]
    placed = in_log_order(context).withColumn(
        "batch", F.floor(F.col("position") / LOG_BATCH).cast("long")
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("rec"))))
    return (
        placed.groupBy("batch")
        .agg(F.transform(ordered, lambda r: r["rec"]).alias("recommendations"))
        .transform(lambda b: as_events(b, run_id, "decision", "batch_complete", "batch", "recommendations"))
    )


def log_run(run: PricingRun, run_id: str, path: str) -> None:
    """Appends the run's events: stage summary, recommendation batches, execution results."""
    stages = as_events(run.summary.drop("run_id"), run_id, "pipeline", "run_complete")
    results = as_events(run.results, run_id, "approval", "execution_result")
    for events in (decision_events(run.context, run_id), results, stages):
        append_events(events, path)


def logged_metrics(events: DataFrame, run_id: str, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Metrics of one run as an audit event of their own."""
    metrics = run_metrics(events.filter(F.col("run_id") == run_id), policy)
    return as_events(metrics.drop("run_id"), run_id, "pipeline", "eval_metrics")
