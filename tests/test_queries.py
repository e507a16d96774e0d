"""Every registered query on the smallest data folder, against its SQL where there is one."""

import contextlib
import io
import os

import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, plain

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the data folder")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = _plan(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    found = [r.asDict() for r in df.collect()]
    assert found
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    rel = db.sql(sql)
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    as_rows = lambda rows: sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)
    assert as_rows(found) == as_rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "sku", "our_price", "avg_competitor_price", "price_delta_pct", "notes",
    ]


def test_limits_reach_the_scan_and_the_map_side(spark, tmp_path):
    from frames import DAY, prices

    from pricemill.sources import snapshots, tables

    prices(spark, ("A", "x", 1, True, 0)).write.parquet(f"{tmp_path}/p")
    stored = tables.read_prices(spark, f"{tmp_path}/p")
    assert "PushedFilters: [In(sku" in _plan(tables.prices_for_skus(stored, ["A", "B"]))
    narrow = tables.prices_for_sku(stored, "A").select("price")
    assert "ReadSchema: struct<sku:string,price:double>" in _plan(narrow)
    ranked = snapshots.last_per_key(stored, ["sku"], ["date", "competitor"])
    assert _plan(ranked).count("WindowGroupLimit") == 2
    assert DAY
