import datetime as dt
import math
import random
import statistics

import pytest
from frames import catalog, prices
from pyspark.sql import functions as F

from pricemill import schemas
from pricemill.operators import approval, calls, elasticity, metrics, recommendations
from pricemill.operators.market import analyze_market
from pricemill.operators.medians import exact_median, upper_median
from pricemill.params import Policy
from pricemill.plans import daily_run
from pricemill.sources.audit_log import append_events, as_events, read_events

T0 = dt.datetime(2026, 1, 1, 12, 0, 0)


def rec(sku="A", current=100.0, price=95.0, confidence=0.95, violation="none", reversible=True):
    return (sku, current, price, confidence, "r", 0.3, reversible, violation, "llm")


def routed(spark, *recs):
    df = spark.createDataFrame(list(recs), schemas.RECOMMENDATIONS)
    return approval.route(df)


def test_routing_needs_confidence_clean_and_reversible(spark, rows):
    r = routed(
        spark,
        rec("A"),
        rec("B", confidence=0.5),
        rec("C", confidence=0.9),
        rec("D", violation="below_min_margin"),
        rec("E", reversible=False),
    )
    assert rows(r.filter("outcome = 'auto_approved'"), "sku") == [("A",), ("C",)]
    totals = approval.routing_totals(r).first()
    assert tuple(totals) == (5, 2, 2, 1)
    assert rows(approval.outcome_counts(r)) == [("auto_approved", 2), ("queued_for_review", 3)]


def test_queued_item_is_pending_and_not_executed(spark, rows):
    r = routed(spark, rec(confidence=0.5))
    assert rows(approval.to_queue(r, "r1"), "run_id", "sku", "status") == [("r1", "A", "pending")]
    assert rows(approval.execute(r)) == [("A", "queued_for_review", 100.0, 100.0, False)]


def test_first_answer_in_time_decides(spark, rows):
    pending = spark.createDataFrame(
        [("r", s, T0) for s in ("in", "late", "none", "twice", "edge", "early")],
        "run_id string, sku string, created_at timestamp",
    )
    answer = lambda sku, ok, sec: ("r", sku, ok, T0 + dt.timedelta(seconds=sec))
    decisions = spark.createDataFrame(
        [answer("in", True, 10), answer("late", True, 301), answer("twice", False, 20), answer("twice", True, 30),
         answer("edge", True, 300), answer("early", True, -1)],
        schemas.DECISIONS,
    )
    found = dict(rows(approval.resolve_answers(pending, decisions), "sku", "outcome"))
    assert found == {
        "in": "human_approved", "late": "timed_out", "none": "timed_out", "twice": "human_rejected",
        "edge": "human_approved", "early": "timed_out",
    }


def test_suggestions_fall_back_and_insane_ones_are_kept_apart(spark):
    c = catalog(spark, *[(s, 100, 50, 50) for s in "ABCDEF"])
    p = prices(spark, *[(s, "x", 90, True, 0) for s in "ABCDE"])
    a = analyze_market(c, p)
    s = spark.createDataFrame(
        [("A", 95.0, 0.8, "s"), ("B", 0.0, 0.8, "s"), ("C", 95.0, 1.2, "s"), ("D", 130.0, 0.9, "s"), ("E", 113.0, 0.95, "s")],
        schemas.SUGGESTIONS,
    )
    made = recommendations.recommend_from_suggestions(a, s)
    got = {r.sku: r for r in made.accepted.collect()}
    assert (got["A"].recommended_price, got["A"].confidence, got["A"].reasoning) == (95.0, 0.8, "s")
    assert [got[k].recommended_price for k in "BC"] == [90.0, 90.0] and got["B"].confidence == 0.5
    assert got["F"].recommended_price == 100.0
    assert got["A"].reversible and not got["E"].reversible and got["A"].projected_margin_pct == 0.4737
    [bad] = made.rejected.collect()
    assert (bad.sku, bad.reason) == ("D", "change_exceeds_maximum")


def test_daily_run_writes_back_and_logs(spark, rows, tmp_path):
    """Two flagged products share a category and are priced together; one stands alone."""
    c = catalog(spark, ("A", 100, 50, 50, "c"), ("B", 100, 50, 50, "c"), ("S", 100, 50, 50, "d"), ("N", 100, 50, 50, "e"))
    p = prices(spark, *[(s, "x", 90, True, 0) for s in "ABS"], ("N", "x", 100, True, 0))
    e = spark.createDataFrame([("c", -2.0)], schemas.ELASTICITY)
    s = spark.createDataFrame([("S", 96.0, 0.95, "s")], schemas.SUGGESTIONS)
    run = daily_run.pricing_run(c, p, e, s, run_id="r1")
    assert run.summary.first().asDict() == {
        "run_id": "r1", "skus_requested": 4, "skus_found": 4, "flagged": 3, "recommendations": 3,
        "executed": 1 + sum(r.executed for r in run.results.filter("sku <> 'S'").collect()),
        "queued_for_review": 3 - sum(r.executed for r in run.results.collect()),
    }
    assert dict(rows(run.recommendations, "sku", "source")) == {"A": "optimizer", "B": "optimizer", "S": "llm"}
    new = dict(rows(run.new_catalog, "sku", "our_price"))
    assert new["S"] == 96.0 and new["N"] == 100.0
    assert run.queue.count() == run.results.filter("outcome = 'queued_for_review'").count()
    waiting = spark.createDataFrame([("r1", "A", 100.0, 90.0, T0)], "run_id string, sku string, current_price double, recommended_price double, created_at timestamp")
    yes = spark.createDataFrame([("r1", "A", True, T0)], schemas.DECISIONS)
    assert rows(daily_run.settle_queue(waiting, yes)) == [("A", "human_approved", 100.0, 90.0, True)]
    daily_run.log_run(run, "r1", str(tmp_path / "log"))
    events = read_events(spark, str(tmp_path / "log"), "r1")
    assert events.filter("event = 'execution_result'").count() == 3
    m = metrics.run_metrics(events).first()
    assert (m.llm_recommendations, m.optimizer_recommendations, m.tool_success_rate) == (1, 2, None)


def audit(spark, *events):
    return spark.createDataFrame(
        [(T0, "r", agent, event, data, None) for agent, event, data in events], schemas.EVENTS
    )


def payload(success=None, attempts=None, successes=None, recs=None):
    return (success, None, attempts, successes, recs)


def test_run_metrics_of_the_reference_cases(spark, rows):
    flagged = [
        ("IN-RANGE", 100.0, None, 90.0, 110.0, 0.0),
        ("REAL-TREND", 500.0, "llm", 90.0, 110.0, 0.05),
        ("FAKE-TREND", 500.0, "llm", 90.0, 110.0, 0.001),
        ("NO-TREND-DATA", 500.0, None, 90.0, 110.0, None),
        ("NO-RANGE", 500.0, "llm", None, 110.0, None),
        ("JOINT", 500.0, "optimizer", 90.0, 110.0, None),
    ]
    events = audit(
        spark,
        ("tool", "a", payload(success=True)),
        ("tool", "b", payload(success=False)),
        ("decision", "llm_stats", payload(attempts=10, successes=7)),
        ("decision", "batch_complete", payload(recs=flagged)),
    )
    m = metrics.run_metrics(events).first()
    assert tuple(m) == ("r", 0.5, 0.7, 5, 1, 2)
    assert rows(metrics.flagged_recommendations(events), "position", "sku") == [
        (2, "FAKE-TREND"), (3, "NO-TREND-DATA"),
    ]
    none = metrics.run_metrics(audit(spark, ("x", "y", payload()))).first()
    assert none.tool_success_rate is None and none.schema_success_rate is None


def test_audit_log_round_trip_and_summaries(spark, tmp_path):
    rows_ = spark.range(1).select(
        F.sequence(F.lit(1), F.lit(30)).alias("long"), F.array(F.lit(1)).alias("short"), F.lit(True).alias("success")
    )
    log = str(tmp_path / "log")
    append_events(as_events(rows_, "r1", "tool", "t", summarize_over=20), log)
    append_events(as_events(rows_, "r2", "tool", "t", "success"), log)
    text = spark.read.json(log).filter("run_id = 'r1'").first().data
    assert '"<30 items>"' in text
    assert read_events(spark, log, "r2").first().data.success is True
    assert read_events(spark, log).count() == 2


def call_rows(spark, *rows_):
    return spark.createDataFrame([("r", *r) for r in rows_], schemas.CALLS)


def test_call_stats(spark):
    c = call_rows(
        spark,
        (1, "a", "m0", 0, 1, False, None, None, 5),
        (2, "a", "m0", 0, 2, True, 100, 10, 40),
        (3, "b", "m0", 0, 3, False, 100, 10, 30),
        (4, "b", "m1", 1, 1, True, 100, 10, 20),
        (5, "c", "m1", 1, 3, False, 100, 10, 10),
    )
    requests = spark.createDataFrame(
        [("r", i, k) for i, k in enumerate(["a", "a", "b", "c"])], schemas.REQUESTS
    )
    s = calls.call_stats(c, requests, in_rate=1.0, out_rate=2.0).first()
    assert (s.generate_attempts, s.generate_successes, s.llm_calls, s.retries) == (4, 4, 4, 1)
    assert (s.fallback_model_used, s.rule_fallback_used) == (1, 1)
    assert s.models_used == {"m0": 1, "m1": 1} and s.latency_p50_ms == 30
    assert s.estimated_cost_usd == pytest.approx(480 / 1e6)


def test_budget_stops_at_calls_and_at_cost(spark):
    many = call_rows(spark, *[(i, "a", "m", 0, 1, True, 1000, 0, 1) for i in range(150)])
    assert calls.within_budget(many, 0.0, 0.0).count() == 100
    assert calls.within_budget(many, 125.0, 0.0).count() == 8
    assert calls.within_budget(many, 0.0, 0.0, Policy(max_calls=7)).count() == 7


def test_budget_counts_replies_only(spark):
    lost = [(i, "a", "m", 0, 1, False, None, None, 1) for i in range(150)]
    replies = [(150 + i, "a", "m", 0, 1, True, 1000, 0, 1) for i in range(130)]
    rows = calls.within_budget(call_rows(spark, *lost, *replies), 0.0, 0.0)
    assert rows.count() == 250 and rows.agg({"seq": "max"}).first()[0] == 249
    costly = calls.within_budget(call_rows(spark, *lost, *replies), 125.0, 0.0)
    assert costly.count() == 158


def test_stopped_request_and_run_without_requests(spark):
    c = call_rows(spark, (1, "a", "m0", 0, 1, False, None, None, 5))
    requests = spark.createDataFrame([("r", 0, "a"), ("r", 1, "never"), ("q", 2, "b")], schemas.REQUESTS)
    found = {r.run_id: r for r in calls.call_stats(c, requests).collect()}
    # one failed attempt of six: stopped by the budget, not answered by rule
    assert (found["r"].generate_attempts, found["r"].generate_successes) == (2, 0)
    assert (found["q"].generate_attempts, found["q"].generate_successes) == (1, 0)
    assert found["r"].models_used == {}
    alone = calls.call_stats(c, requests.filter("run_id = 'q'")).collect()
    assert {r.run_id for r in alone} == {"q", "r"}


def test_medians(spark, rows):
    v = spark.createDataFrame(
        [("a", x) for x in (1.0, 5.0, 2.0)] + [("b", x) for x in (4.0, 1.0, 1.0, 9.0)] + [("c", -1e9), ("c", 1e9)],
        "g string, v double",
    )
    assert rows(exact_median(v, "g", "v")) == [("a", 2.0), ("b", 2.5), ("c", 0.0)]
    whole = v.filter("g <> 'c'").withColumn("v", F.col("v").cast("long"))
    assert rows(upper_median(whole, "g", "v")) == [("a", 2), ("b", 4)]


def test_medians_of_any_magnitude(spark, rows):
    rng = random.Random(5)
    data = []
    for g in range(12):
        for _ in range(rng.randrange(1, 60)):
            size = rng.choice((1.0, rng.random(), 2.0 ** rng.randrange(-1074, 1024), 10 ** rng.uniform(-6, 12), 1 + rng.random() * 1e-13, 0.0))
            data.append((str(g), size * rng.choice((1, -1))))
    data += [("near", 1 + i * 2.0**-52) for i in range(101)] + [("ends", math.inf), ("ends", -math.inf), ("ends", 5e-324), ("none", None)]
    own = {}
    for g, x in data:
        own.setdefault(g, []).append(x)
    want = [(g, statistics.median(xs)) for g, xs in own.items() if g != "none"]
    found = rows(exact_median(spark.createDataFrame(data, "g string, v double"), "g", "v"))
    assert found == sorted(want, key=str)


def test_decisions_in_log_order(spark, rows, tmp_path):
    n = 100_000
    fields = {f.name: f.dataType for f in schemas.LOGGED_RECOMMENDATION.fields}
    context = spark.range(n).select(
        F.lpad((F.col("id") * 7919 % n).cast("string"), 6, "0").alias("sku"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in fields.items() if c != "sku"],
    )
    append_events(daily_run.decision_events(context, "r"), str(tmp_path))
    found = metrics.logged_recommendations(read_events(spark, str(tmp_path), "r"))
    skus = [r.sku for r in found.orderBy("batch", "position").select("rec.sku").collect()]
    assert skus == [f"{i:06d}" for i in range(n)]
    assert found.agg(F.max("position")).first()[0] == daily_run.LOG_BATCH - 1


def test_elasticity_filters_and_planted_slope(spark, rows):
    def sku(name, n, gaps, base, e, capped=False):
        return [(name, "c", g, base * (1 + e * g), capped) for g in (gaps * n)[:n]]

    spread = [-0.08, -0.03, 0.0, 0.02, 0.07]
    data = (
        sku("good", 10, spread, 20.0, -2.0) + sku("good", 3, [0.5], 1.0, 0.0, capped=True)
        + sku("few", 7, spread, 20.0, -9.0) + sku("flat", 10, [0.01], 20.0, -9.0) + sku("slow", 10, spread, 0.5, -9.0)
        + sku("also", 8, spread, 30.0, -3.0)
    )
    sales = spark.createDataFrame(data, schemas.SALES)
    assert rows(elasticity.sku_fits(sales), "sku") == [("also",), ("good",)]
    assert rows(elasticity.estimate_elasticity(sales)) == [("c", -2.5)]
    known = spark.createDataFrame([("c", -2.0)], schemas.ELASTICITY)
    assert elasticity.mean_abs_error(elasticity.estimate_elasticity(sales), known).first()[0] == 0.5
