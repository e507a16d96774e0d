"""Approval routing, human answers and execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill import schemas
from pricemill.params import DEFAULT_POLICY, Policy


def can_auto_approve(policy: Policy = DEFAULT_POLICY) -> Column:
    return (
        (F.col("confidence") >= policy.auto_confidence)
        & (F.col("guardrail_violation") == "none")
        & F.col("reversible")
    )


def route(recommendations: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Adds `outcome`: executed without a human, or queued for review."""
    schemas.require(recommendations, schemas.RECOMMENDATIONS, "recommendations")
    auto = F.coalesce(can_auto_approve(policy), F.lit(False))
    return recommendations.withColumn(
        "outcome", F.when(auto, "auto_approved").otherwise("queued_for_review")
    )


def to_queue(routed: DataFrame, run_id: str) -> DataFrame:
    """Pending rows of the review queue for everything that was not approved."""
    return routed.filter("outcome = 'queued_for_review'").select(
        F.lit(run_id).alias("run_id"),
        "sku",
        "current_price",
        "recommended_price",
        "confidence",
        "guardrail_violation",
        "reasoning",
        F.current_timestamp().alias("created_at"),
        F.lit("pending").alias("status"),
    )


def resolve_answers(
    pending: DataFrame, decisions: DataFrame, policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Adds `outcome` to queued rows: the first human answer in time, else timed_out.

    The answers are reduced to one per (run, sku) in the same aggregate that tests the time
    limit, so many answers to one item cost one row per map task.
    """
    key = ["run_id", "sku"]
    asked = pending.select(*key, "created_at")
    limit = F.make_interval(secs=F.lit(policy.answer_seconds))
    first = (
        decisions.join(asked, key)
        .filter(F.col("decided_at").between(F.col("created_at"), F.col("created_at") + limit))
        .groupBy(*key, "created_at")
        .agg(F.min_by("approved", "decided_at").alias("approved"))
    )
    outcome = (
        F.when(F.col("approved"), "human_approved")
        .when(~F.col("approved"), "human_rejected")
        .otherwise("timed_out")
    )
    return (
        pending.join(first, [*key, "created_at"], "left")
        .withColumn("outcome", outcome)
        .drop("approved")
    )


def execute(routed: DataFrame) -> DataFrame:
    """Execution result of each routed recommendation; approved ones get the new price."""
    executed = F.col("outcome").isin("auto_approved", "human_approved")
    return routed.select(
        "sku",
        "outcome",
        F.col("current_price").alias("old_price"),
        F.when(executed, F.col("recommended_price"))
        .otherwise(F.col("current_price"))
        .alias("new_price"),
        executed.alias("executed"),
    )


def outcome_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("outcome").agg(F.count(F.lit(1)).alias("recommendations"))


def routing_totals(routed: DataFrame) -> DataFrame:
    """One row: recommended, auto-approved, escalated, blocked by a guardrail."""
    clean = F.col("guardrail_violation") == "none"
    auto = F.col("outcome") == "auto_approved"
    return routed.agg(
        F.count(F.lit(1)).alias("recommendations"),
        F.count_if(auto).alias("auto_approved"),
        F.count_if(~auto & clean).alias("escalated"),
        F.count_if(~clean).alias("blocked_by_guardrail"),
    )
