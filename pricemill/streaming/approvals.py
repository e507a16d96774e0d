"""Answers to queued recommendations as a stream-stream join with a time limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.params import DEFAULT_POLICY, Policy


def resolve_stream(
    pending: DataFrame,
    decisions: DataFrame,
    policy: Policy = DEFAULT_POLICY,
    lateness: str = "1 minute",
) -> DataFrame:
    """Queued rows with their answers in time, or `timed_out` once no answer can come any more.

    pending: run_id, sku, created_at; decisions: run_id, sku, approved, decided_at. A row without
    an answer leaves when both watermarks have passed its time limit. Several answers in time
    give several rows; `first_answers` keeps the earliest.
    """
    p = pending.withWatermark("created_at", lateness).alias("p")
    d = decisions.withWatermark("decided_at", lateness).alias("d")
    limit = F.expr(f"INTERVAL {policy.answer_seconds} SECONDS")
    match = (
        (F.col("p.run_id") == F.col("d.run_id"))
        & (F.col("p.sku") == F.col("d.sku"))
        & (F.col("d.decided_at") >= F.col("p.created_at"))
        & (F.col("d.decided_at") <= F.col("p.created_at") + limit)
    )
    outcome = (
        F.when(F.col("d.approved"), "human_approved")
        .when(~F.col("d.approved"), "human_rejected")
        .otherwise("timed_out")
    )
    return p.join(d, match, "leftOuter").select(
        "p.run_id", "p.sku", "p.created_at", "d.decided_at", outcome.alias("outcome")
    )


def first_answers(resolved: DataFrame) -> DataFrame:
    """Batch view over the resolved rows: the earliest answer per queued row."""
    return resolved.groupBy("run_id", "sku", "created_at").agg(
        F.min_by("outcome", "decided_at").alias("answered"),
        F.max("outcome").alias("_any"),
    ).select("run_id", "sku", "created_at", F.coalesce("answered", "_any").alias("outcome"))
