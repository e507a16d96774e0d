"""Stored tables, published refreshes, the damaged log, rules of all tables, mergeable sums, stopped requests."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill import schemas
from pricemill.operators import calls, constraints, elasticity
from pricemill.sources import audit_log, stored_tables
from pricemill.sources.snapshots import PRICE_KEY

SCHEMA = "sku string, competitor string, date date, price double, in_stock boolean"


def day(n):
    return dt.date(2026, 8, n)


def files(path):
    return {
        os.path.join(root, f): os.stat(os.path.join(root, f)).st_mtime_ns
        for root, _, names in os.walk(path)
        for f in names
        if f.endswith(".parquet")
    }


def test_second_upsert_leaves_untouched_folders_alone(spark, tmp_path, rows):
    path = f"{tmp_path}/prices"
    first = [(f"s{i}", "a", day(d), 1.0 + i, True) for i in range(20) for d in range(1, 9)]
    stored_tables.create_stored(spark.createDataFrame(first, SCHEMA), path, ("date",))
    before = files(path)
    late = [("s1", "a", day(3), 9.0, False, 1), ("s1", "a", day(3), 8.0, True, 2), ("new", "b", day(3), 5.0, True, 1)]
    incoming = spark.createDataFrame(late, SCHEMA + ", arrival long")
    assert stored_tables.upsert_stored(path, incoming, PRICE_KEY, ("date",), ["arrival"]) == 1
    after = files(path)
    kept = before.keys() & after.keys()
    assert len(before) > 1 and len(before) - len(kept) == 1 and all(before[f] == after[f] for f in kept)
    want = {(s, c, d): (p, i) for s, c, d, p, i in first}
    want[("s1", "a", day(3))], want[("new", "b", day(3))] = (8.0, True), (5.0, True)
    found = stored_tables.read_stored(spark, path)
    assert rows(found, "sku", "competitor", "date", "price", "in_stock") == sorted(
        ((*k, *v) for k, v in want.items()), key=str
    )
    # the same delivery again changes nothing, an empty one touches nothing
    stored_tables.upsert_stored(path, incoming, PRICE_KEY, ("date",), ["arrival"])
    assert stored_tables.read_stored(spark, path).count() == len(want)
    assert stored_tables.upsert_stored(path, incoming.limit(0), PRICE_KEY, ("date",), ["arrival"]) == 0


def test_a_refresh_that_dies_between_its_tables_is_not_seen(spark, tmp_path):
    root = f"{tmp_path}/published"
    with pytest.raises(FileNotFoundError):
        stored_tables.read_published(spark, root, "listings")
    one, two = spark.range(3).toDF("a"), spark.range(5).toDF("a")
    assert stored_tables.publish({"listings": one, "prices": one}, root) == 1
    broken = two.withColumn("a", F.raise_error(F.lit("died")).cast("long"))
    with pytest.raises(Exception, match="died"):
        stored_tables.publish({"listings": two, "prices": broken}, root)
    seen = stored_tables.read_published(spark, root, "listings", "prices")
    assert [t.count() for t in seen.values()] == [3, 3]
    assert stored_tables.publish({"listings": two, "prices": two}, root) == 2
    # a frame that was read before the new version still reads the old one
    assert [t.count() for t in seen.values()] == [3, 3]
    assert [t.count() for t in stored_tables.read_published(spark, root, "listings", "prices").values()] == [5, 5]


def test_damaged_lines_come_back(spark, tmp_path):
    path = f"{tmp_path}/log"
    good = spark.createDataFrame([(0.9, [1, 2, 3])], "confidence double, items array<int>")
    audit_log.append_events(audit_log.as_events(good, "r1", "decision", "made"), path)
    audit_log.append_events(audit_log.as_events(good, "r2", "decision", "made"), path)
    lines = [("r1", '{"timestamp": "2026-08-'), ("r1", "not json at all"), ("r1", '{"agent": "a", "data": "{oops"}'), ("r2", "x")]
    spark.createDataFrame(lines, "run_id string, value string").write.mode("append").partitionBy("run_id").text(path)
    payload = T.StructType([T.StructField("confidence", T.DoubleType())])
    found = audit_log.read_log(spark, path, "r1", payload).collect()
    assert sorted(str(r.damaged) for r in found) == ["None", "not json at all", '{"timestamp": "2026-08-', "{oops"]
    assert [r.data.confidence for r in found if r.damaged is None] == [0.9]
    assert [r.agent for r in found if r.damaged == "{oops"] == ["a"] and {r.run_id for r in found} == {"r1"}
    assert audit_log.read_events(spark, path, "r1").count() == 1 and audit_log.read_log(spark, path).count() == 6
    plan = audit_log.read_log(spark, path, "r1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_rules_are_counted_in_one_pass(spark, rows):
    data = [("a", 0.0, 0.5), ("b", 5.0, 2.0), (None, None, None), ("c", 3.0, 1.0)]
    df = spark.createDataFrame(data, "sku string, recommended_price double, confidence double")
    counts, marked = constraints.rule_counts(
        {"suggestions": (df, constraints.suggestion_rules()), "none": (df.limit(0), constraints.suggestion_rules())}
    )
    assert rows(counts) == [
        ("none", "confidence_out_of_range", 0, 0), ("none", "recommended_price_too_low", 0, 0),
        ("suggestions", "confidence_out_of_range", 1, 4), ("suggestions", "recommended_price_too_low", 1, 4),
    ]
    broken = marked["suggestions"].filter("size(violations) > 0")
    assert sorted((r.sku, r.violations[0]) for r in broken.collect()) == [
        ("a", "recommended_price_too_low"), ("b", "confidence_out_of_range"),
    ]


def test_schema_differences_go_down_into_nested_types(spark):
    wanted = T.StructType.fromDDL("a long, b array<struct<x:double,y:string>>, c map<string,struct<z:date>>, d string")
    found = T.StructType.fromDDL("a int, b array<struct<x:string>>, c map<int,struct<z:string>>, extra int")
    assert schemas.differences(wanted, found) == [
        ("b[].x", "double", "string"), ("b[].y", "string", "missing"), ("c{key}", "string", "int"),
        ("c{}.z", "date", "string"), ("d", "string", "missing"),
    ]
    df = spark.createDataFrame([], found)
    with pytest.raises(schemas.ContractError, match=r"b\[\].x: expected double, found string"):
        schemas.require(df, wanted, "test")
    assert schemas.differences(wanted, wanted) == []


def test_merged_sums_equal_the_full_fit(spark, tmp_path):
    sold = spark.range(3000).select(
        (F.col("id") % 3).alias("batch"),
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("sku"),
        F.lit("c").alias("category"),
        ((F.col("id") * 37 % 161 - 80) / 1000.0).alias("gap"),
        F.when(F.col("id") % 50 != 0, F.lit(20.0) + F.col("id") % 5).alias("units"),
        (F.col("id") % 11 == 0).alias("capped"),
    )
    path = f"{tmp_path}/sums"
    # the last batch is delivered twice
    for k in (0, 1, 2, 2):
        elasticity.append_sales(sold.filter(f"batch = {k}"), path, f"b{k}")
    merged = {r.sku: r for r in elasticity.fits_from_sums(elasticity.stored_sums(spark, path)).collect()}
    whole = {r.sku: r for r in elasticity.sku_fits(sold.filter("units is not null")).collect()}
    assert merged.keys() == whole.keys() and len(whole) == 7
    for sku, r in whole.items():
        assert merged[sku].observations == r.observations
        for name in ("slope", "intercept", "gap_std", "mean_units", "elasticity"):
            assert merged[sku][name] == pytest.approx(r[name], rel=1e-9)


def test_stopped_requests_are_neither_success_nor_rule_answer(spark):
    def attempts(key, *outcomes):
        return [
            ("r", i, key, f"m{i // 3}", i // 3, i % 3 + 1, ok, 10, 1, 5) for i, ok in enumerate(outcomes)
        ]

    log = attempts("first try", True) + attempts("second model", False, False, False, True)
    log += attempts("by rule", *[False] * 6) + attempts("stopped", False, False) + attempts("stopped late", *[False] * 5)
    df = spark.createDataFrame(log, schemas.CALLS)
    r = calls.call_stats(df).first()
    assert (r.generate_attempts, r.generate_successes, r.rule_fallback_used) == (5, 3, 1)
    asked = spark.createDataFrame([("r", i, k) for i, k in enumerate(("first try", "first try", "stopped", "never begun"))], schemas.REQUESTS)
    r = calls.call_stats(df, asked).first()
    assert (r.generate_attempts, r.generate_successes) == (4, 2)
