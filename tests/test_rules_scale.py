"""Rule counts of large tables: made by an aggregate when asked for, not row by row during the write."""

from pricemill.operators import constraints
from pricemill.plans import queries as Q
from pricemill.plans import standins as S

FOLDER = "/root/testdata/sf0.001"


def test_counts_are_an_aggregate_over_the_written_tables(spark, rows):
    data = [("a", 0.0, 0.5), ("b", 0.0, 2.0), ("c", 3.0, 1.0)]
    df = spark.createDataFrame(data, "sku string, recommended_price double, confidence double")
    counts, _ = constraints.rule_counts({"suggestions": (df, constraints.suggestion_rules())})
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "CollectMetrics" not in plan
    assert rows(counts) == [
        ("suggestions", "confidence_out_of_range", 1, 3), ("suggestions", "recommended_price_too_low", 2, 3),
    ]


def test_prices_are_made_once_for_all_six_tables(spark, monkeypatch):
    made, whole = [], S.prices
    monkeypatch.setattr(S, "prices", lambda *a: made.append(1) or whole(*a))
    assert Q.rule_counts(spark, FOLDER).count() == 33
    assert len(made) == 1
