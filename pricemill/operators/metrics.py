"""Quality metrics of all runs at once, from the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill import schemas
from pricemill.params import DEFAULT_POLICY, Policy

def _is(agent: str, event: str | None = None) -> Column:
    hit = F.col("agent") == agent
    return hit if event is None else hit & (F.col("event") == event)


def _source(rec: Column) -> Column:
    return F.coalesce(rec["source"], F.lit("llm"))


def out_of_range_without_trend(rec: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """Price outside the competitor range with no trend to justify it; suggestions only.

    A missing range never flags, a missing trend never justifies, a missing source counts as a
    suggestion.
    """
    price = rec["recommended_price"]
    low, high = rec["min_competitor_price"], rec["max_competitor_price"]
    outside = low.isNotNull() & high.isNotNull() & ((price < low) | (price > high))
    justified = F.abs(rec["avg_competitor_trend_pct"]) >= policy.trend_noise
    return (
        (_source(rec) == "llm")
        & F.coalesce(outside, F.lit(False))
        & ~F.coalesce(justified, F.lit(False))
    )


def logged_recommendations(events: DataFrame) -> DataFrame:
    """One row per logged recommendation, with its place in the log: batch (0 where events have no number), position."""
    batches = events.filter(_is("decision", "batch_complete"))
    number = F.col("data.batch") if "batch" in events.schema["data"].dataType.names else F.lit(None).cast("long")
    return batches.select(
        "run_id",
        "timestamp",
        F.coalesce(number, F.lit(0).cast("long")).alias("batch"),
        F.posexplode("data.recommendations").alias("position", "rec"),
    )


def flagged_recommendations(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The suspicious recommendations as rows, a run's list having no size limit; log order is timestamp, batch, position."""
    return (
        logged_recommendations(events)
        .filter(out_of_range_without_trend(F.col("rec"), policy))
        .select("run_id", "timestamp", "batch", "position", F.col("rec.sku").alias("sku"))
    )


def run_metrics(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """One row per run. Rates are null without events.

    Everything comes from one pass over the log and one partial-then-final aggregate by run:
    counts inside a batch are taken from its array, without exploding it.
    """
    schemas.require(events, schemas.EVENTS, "events", optional=("latency_ms",))
    recs = F.when(_is("decision", "batch_complete"), F.col("data.recommendations"))
    stats = _is("decision", "llm_stats")
    success = F.coalesce("data.success", F.lit(False)).cast("double")

    def total(keep) -> Column:
        return F.coalesce(F.sum(F.array_size(F.filter(recs, keep))), F.lit(0))

    return events.groupBy("run_id").agg(
        F.round(F.avg(F.when(_is("tool"), success)), 6).alias("tool_success_rate"),
        F.round(
            F.try_divide(
                F.coalesce(F.sum(F.when(stats, F.col("data.generate_successes"))), F.lit(0)),
                F.coalesce(F.sum(F.when(stats, F.col("data.generate_attempts"))), F.lit(0)),
            ),
            6,
        ).alias("schema_success_rate"),
        total(lambda r: _source(r) == "llm").alias("llm_recommendations"),
        total(lambda r: r["source"] == "optimizer").alias("optimizer_recommendations"),
        total(lambda r: out_of_range_without_trend(r, policy)).alias("hallucination_flags"),
    )
