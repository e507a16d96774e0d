"""Statistics and budget of the calls to an outside model, from a call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemill import schemas
from pricemill.functions.demand import call_cost
from pricemill.operators.medians import upper_median
from pricemill.params import DEFAULT_POLICY, Policy


def with_cost(calls: DataFrame, in_rate: float, out_rate: float) -> DataFrame:
    """Adds `cost_usd` per call from rates per million tokens."""
    return calls.withColumn(
        "cost_usd", call_cost(F.col("tokens_in"), F.col("tokens_out"), in_rate, out_rate)
    )


def within_budget(
    calls: DataFrame, in_rate: float, out_rate: float, policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Attempts made before the run reached its call or cost limit.

    Only attempts with a reply (`tokens_in` not null) count as calls and cost anything; one without a
    reply passes as long as the limits hold. At most `max_calls` replies of a run decide where it
    stops, and Spark keeps no more than that per map task ahead of the shuffle.
    """
    order = Window.partitionBy("run_id").orderBy("seq")
    replies = (
        calls.filter(F.col("tokens_in").isNotNull())
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= policy.max_calls)
    )
    spent = with_cost(replies, in_rate, out_rate).withColumn("_spent", F.sum("cost_usd").over(order))
    # the reply that reaches a limit is the last attempt of its run
    reached = (F.col("_n") == policy.max_calls) | (F.col("_spent") >= policy.max_cost_usd)
    stops = spent.filter(reached).groupBy("run_id").agg(F.min("seq").alias("_stop"))
    made = calls.join(stops, "run_id", "left").filter(
        F.col("_stop").isNull() | (F.col("seq") <= F.col("_stop"))
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        with_cost(made.drop("_stop"), in_rate, out_rate)
        .withColumn("spent_before", F.coalesce(F.sum("cost_usd").over(before), F.lit(0.0)))
    )


def call_stats(
    calls: DataFrame,
    requests: DataFrame | None = None,
    in_rate: float = 0.0,
    out_rate: float = 0.0,
    max_retries: int = 2,
    models: int = 2,
) -> DataFrame:
    """One row per run: requests, calls, retries, fallbacks, tokens, cost and latency.

    Attempts on a request go through `models` models in turn, each with `max_retries` retries. A request that none
    answered is answered by rule, which is a success; one whose attempts end before the last was used was
    stopped by the budget, and is neither.

    calls: one row per attempt. `tokens_in` is null where the attempt got no reply, which makes
    it a retry but not a counted call. requests: every request made, cached repeats included;
    without it each request key is taken as one request.
    """
    schemas.require(calls, schemas.CALLS, "calls")
    replied = F.col("tokens_in").isNotNull()
    cost = call_cost(F.col("tokens_in"), F.col("tokens_out"), in_rate, out_rate)
    totals = calls.groupBy("run_id").agg(
        F.count_if(replied).alias("llm_calls"),
        F.count_if(~F.col("ok") & (F.col("attempt") <= max_retries)).alias("retries"),
        F.count_if(F.col("ok") & (F.col("model_rank") > 0)).alias("fallback_model_used"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("output_tokens"),
        F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 6).alias("estimated_cost_usd"),
    )
    # the last attempt there can be; a stopped request never comes to it
    last = (F.col("model_rank") == models - 1) & (F.col("attempt") == max_retries + 1)
    per_request = calls.groupBy("run_id", "request_key").agg(
        F.max("ok").alias("by_model"), F.max(last & ~F.col("ok")).alias("_used_up")
    )
    by_rule = ~F.col("by_model") & F.col("_used_up")
    per_request = per_request.withColumn("by_rule", by_rule).withColumn("has_answer", F.col("by_model") | by_rule)
    asked = requests.select("run_id", "request_key") if requests is not None else (
        per_request.select("run_id", "request_key")
    )
    # a request without any attempt in the log was stopped before its first: it was made, but has no result
    outcomes = (
        asked.join(per_request, ["run_id", "request_key"], "left")
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("generate_attempts"),
            F.count_if("has_answer").alias("generate_successes"),
        )
        .join(
            per_request.groupBy("run_id").agg(
                F.count_if("by_rule").alias("rule_fallback_used")
            ),
            "run_id",
            "full",
        )
        .withColumns(
            {
                c: F.coalesce(c, F.lit(0)).alias(c)
                for c in ("generate_attempts", "generate_successes", "rule_fallback_used")
            }
        )
    )
    models = (
        calls.filter("ok")
        .groupBy("run_id", "model")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("run_id")
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n")))).alias(
                "models_used"
            )
        )
    )
    p50 = upper_median(calls.filter(replied), "run_id", "latency_ms").withColumnRenamed(
        "upper_median", "latency_p50_ms"
    )
    return (
        outcomes.join(totals, "run_id", "left")
        .join(models, "run_id", "left")
        .withColumn(
            "models_used",
            F.coalesce("models_used", F.create_map().cast("map<string,bigint>")),
        )
        .join(p50, "run_id", "left")
    )


def answers_for_requests(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Each distinct request is answered once and the answer is joined to all its repeats."""
    distinct = answers.dropDuplicates(["run_id", "request_key"])
    return requests.join(distinct, ["run_id", "request_key"], "left")
