import datetime as dt

from frames import DAY, catalog, prices
from pyspark.sql import functions as F

from pricemill import schemas
from pricemill.operators import constraints, scorecard
from pricemill.sources import reference_data, snapshots, tables
from pricemill.streaming import approvals, audit_rate, price_feed


def reference_prices(spark):
    return prices(
        spark,
        ("LAP-0001", "ByteMart", 979.0, True, 0),
        ("LAP-0001", "CircuitHub", 1009.0, False, 0),
        ("HEA-0002", "ByteMart", 189.0, True, 0),
    )


def test_history_of_requested_skus(spark, rows):
    p = reference_prices(spark)
    assert rows(tables.prices_for_skus(p, ["LAP-0001"]), "competitor", "in_stock") == [
        ("ByteMart", True), ("CircuitHub", False),
    ]
    assert tables.prices_for_skus(p, []).count() == 0
    wanted = spark.createDataFrame([("HEA-0002",), ("X",)], "sku string")
    assert rows(tables.prices_for_skus(p, wanted), "sku") == [("HEA-0002",)]
    assert tables.prices_for_skus(p, [f"x{i}" for i in range(1500)] + ["HEA-0002"]).count() == 1
    assert tables.prices_for_sku(p, "LAP-0001").count() == 2
    assert rows(tables.missing_skus(wanted, p)) == [("X",)]
    assert tuple(tables.research_summary(wanted, p).first()) == (2, 1, 1)
    assert tables.distinct_sorted(p, "competitor").collect()[0][0] == "ByteMart"


def test_catalog_files(spark, rows, tmp_path):
    c = catalog(spark, ("A", 10, 5, 3), ("B", 20, 5, 0))
    snapshots.write_snapshot(c, f"{tmp_path}/c")
    assert rows(tables.read_catalog(spark, f"{tmp_path}/c")) == rows(c)
    shuffled = c.select("stock", "sku", "name", "brand", "category", "cost", "our_price")
    shuffled.coalesce(1).write.option("header", True).csv(f"{tmp_path}/csv")
    assert rows(tables.read_catalog_csv(spark, f"{tmp_path}/csv")) == rows(c)


def test_upsert_last_row_wins(spark, rows):
    old = prices(spark, ("A", "x", 1, True, 0), ("A", "y", 2, True, 0))
    new = prices(spark, ("A", "x", 3, True, 0), ("A", "x", 4, False, 0), ("B", "x", 5, True, 0))
    new = new.withColumn("n", F.when(F.col("price") == 3, 2).otherwise(1))
    after = snapshots.upsert(old, new, snapshots.PRICE_KEY, ["n"])
    assert rows(after, "sku", "competitor", "price") == [("A", "x", 3.0), ("A", "y", 2.0), ("B", "x", 5.0)]
    twice = snapshots.last_per_key(new.withColumn("t", F.lit("text")), snapshots.PRICE_KEY, ["n"])
    assert rows(twice, "price", "t") == [(3.0, "text"), (5.0, "text")]


def test_apply_prices_touches_only_executed(spark, rows):
    c = catalog(spark, ("A", 10, 5, 3), ("B", 20, 5, 0))
    done = spark.createDataFrame([("A", 11.0)], "sku string, new_price double")
    assert rows(snapshots.apply_prices(c, done), "sku", "our_price") == [("A", 11.0), ("B", 20.0)]


def test_constraints(spark, rows):
    c = catalog(spark, ("A", 10, 5, 3), ("B", 0, 5, -1), (None, 1, 1, 1))
    good, bad = constraints.split_valid(c, constraints.catalog_rules())
    assert rows(good, "sku") == [("A",)]
    found = {r.sku: r.violations for r in bad.collect()}
    assert found == {"B": ["our_price_not_positive", "stock_negative"], None: ["sku_missing"]}
    p = prices(spark, ("A", "x", 1, True, 0), ("A", "x", 2, True, 0), ("Z", "x", 2, True, 0))
    assert rows(constraints.duplicate_keys(p, snapshots.PRICE_KEY), "sku", "rows") == [("A", 2)]
    assert rows(constraints.orphans(p, c), "sku") == [("Z",)]
    s = spark.createDataFrame([("A", 0.0, 2.0, "r")], schemas.SUGGESTIONS)
    assert constraints.with_violations(s, constraints.suggestion_rules()).first().violations == [
        "recommended_price_too_low", "confidence_out_of_range",
    ]


def test_elasticity_file_and_default(spark, rows, tmp_path):
    path = f"{tmp_path}/e"
    assert reference_data.read_elasticity(spark, path).count() == 0
    reference_data.write_elasticity(spark.createDataFrame([("c", -2.0)], schemas.ELASTICITY), path)
    c = catalog(spark, ("A", 1, 1, 1, "c"), ("B", 1, 1, 1, "d"))
    e = reference_data.with_elasticity(c, reference_data.read_elasticity(spark, path))
    assert rows(e, "sku", "elasticity") == [("A", -2.0), ("B", -1.5)]


def test_queue_and_report_files(spark, tmp_path):
    row = ("r", "A", 1.0, 1.0, 0.5, "none", "x", dt.datetime(2026, 1, 1), "pending")
    q = spark.createDataFrame([row], schemas.PENDING)
    reference_data.append_pending(q, f"{tmp_path}/q")
    reference_data.append_pending(q, f"{tmp_path}/q")
    assert reference_data.read_pending(spark, f"{tmp_path}/q").count() == 2
    reference_data.write_report(q, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 1


def test_guarded_follow_starts_from_yesterdays_price(spark):
    days = spark.createDataFrame(
        [("A", d, m, 5000, 10000) for d, m in enumerate([20000, 20000, 4000, 4000, 4000])],
        "sku string, day int, target_c long, cost_c long, start_c long",
    )
    path = scorecard.guarded_follow(days).orderBy("day").collect()
    assert [r.target_c_price for r in path] == [12500, 15625, 11719, 8790, 6593]
    assert [r.target_c_before for r in path][:2] == [10000, 12500]


def test_scorecard_by_hand(spark):
    d = [DAY, DAY + dt.timedelta(1)]
    rows_ = [
        ("static", "A", d[0], 10.0, 10.0, 6.0, 5.0), ("static", "A", d[1], 10.0, 10.0, 6.0, 5.0),
        ("cut", "A", d[0], 9.0, 10.0, 6.0, 8.0), ("cut", "A", d[1], 6.5, 10.0, 6.0, 9.0),
        ("optimum", "A", d[0], 11.0, 10.0, 6.0, 10.0), ("optimum", "A", d[1], 11.0, 10.0, 6.0, 10.0),
    ]
    card = {r.strategy: r for r in scorecard.scorecard(spark.createDataFrame(rows_, schemas.STRATEGY_DAYS)).collect()}
    assert card["static"].gross_profit == 40 and card["static"].profit_vs_baseline_pct == 0
    assert card["static"].price_changes == 0 and card["optimum"].price_changes == 1
    cut = card["cut"]
    assert (cut.gross_profit, cut.price_changes, cut.guardrail_violations) == (29, 2, 1)
    assert cut.profit_vs_baseline_pct == -28.75 and cut.share_of_bound_uplift_pct == -19.2


def _files(spark, df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_price_feed_stream_equals_batch(spark, rows, tmp_path):
    schema = "sku string, competitor string, price double, in_stock boolean, date date, arrived_at timestamp"
    t = lambda m: dt.datetime(2026, 1, 1, 0, m)
    first = [("A", "x", 10.0, True, DAY, t(0)), ("A", "x", 10.0, True, DAY, t(1)), ("A", "y", 20.0, True, DAY, t(1))]
    second = [("A", "x", 12.0, True, DAY, t(9)), ("A", "x", 11.0, False, DAY, t(5))]
    source, state = f"{tmp_path}/in", f"{tmp_path}/state"
    table = price_feed.PriceTable(spark, f"{tmp_path}/table")
    for part in (first, second):
        _files(spark, spark.createDataFrame(part, schema), source)
        feed = spark.readStream.schema(schema).parquet(source)
        price_feed.maintain_prices(feed, table, state).awaitTermination()
    assert rows(table.read(), "competitor", "price") == [("x", 12.0), ("y", 20.0)]
    assert spark.read.parquet(table.path).count() == 4 - 1  # the exact repeat was dropped, one per batch and key
    compacted = table.compact(f"{tmp_path}/compact", 7)
    assert rows(compacted.read()) == rows(table.read())
    assert rows(price_feed.latest_positions(table.read()), "competitor", "price") == [("x", 12.0), ("y", 20.0)]


def test_value_that_comes_back_is_the_latest(spark, rows, tmp_path):
    schema = "sku string, competitor string, price double, in_stock boolean, date date, arrived_at timestamp"
    values = [(10.0, 0), (12.0, 1), (10.0, 2), (10.0, 2)]
    feed = [("A", "x", p, True, DAY, dt.datetime(2026, 1, 1, 0, m)) for p, m in values]
    _files(spark, spark.createDataFrame(feed, schema), f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    table = price_feed.PriceTable(spark, f"{tmp_path}/table")
    price_feed.maintain_prices(stream, table, f"{tmp_path}/state").awaitTermination()
    assert rows(table.read(), "price") == [(10.0,)]
    kept = price_feed.deduplicated(stream).writeStream.format("memory").queryName("kept").trigger(availableNow=True)
    kept.start().awaitTermination()
    assert spark.table("kept").count() == 3


def test_approval_stream_times_out(spark, rows, tmp_path):
    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    pending = [("r", s, t(0)) for s in ("yes", "no", "late", "none")] + [("r", "marker", t(9000))]
    answers = [("r", "yes", True, t(10)), ("r", "yes", False, t(20)), ("r", "no", False, t(300)),
               ("r", "late", True, t(301)), ("m", "marker", True, t(9000))]
    _files(spark, spark.createDataFrame(pending, "run_id string, sku string, created_at timestamp"), f"{tmp_path}/p")
    _files(spark, spark.createDataFrame(answers, schemas.DECISIONS), f"{tmp_path}/d")
    p = spark.readStream.schema("run_id string, sku string, created_at timestamp").parquet(f"{tmp_path}/p")
    d = spark.readStream.schema(schemas.DECISIONS).parquet(f"{tmp_path}/d")
    out = f"{tmp_path}/out"
    (
        approvals.resolve_stream(p, d).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    )
    done = approvals.first_answers(spark.read.parquet(out)).filter("sku <> 'marker'")
    assert dict(rows(done, "sku", "outcome")) == {
        "yes": "human_approved", "no": "human_rejected", "late": "timed_out", "none": "timed_out",
    }


def test_success_rate_of_a_batch(spark):
    e = spark.createDataFrame(
        [(dt.datetime(2026, 1, 1, 0, m), a, ok) for m, a, ok in ((0, "tool", True), (59, "tool", False), (5, "x", True))],
        "timestamp timestamp, agent string, success boolean",
    )
    r = audit_rate.success_rate(e).first()
    assert (r.events, r.success_rate) == (2, 0.5)
