import pytest
from frames import catalog, prices
from pyspark.sql import functions as F

from pricemill import schemas
from pricemill.functions import guardrails as G
from pricemill.functions import text
from pricemill.functions.money import cents, exact_ratio, half_up
from pricemill.operators import market


def analysis(spark, items, points):
    a = market.analyze_market(catalog(spark, *items), prices(spark, *points))
    return {r["sku"]: r for r in a.collect()}


def test_only_in_stock_latest_prices_count_but_all_count_for_trend(spark):
    a = analysis(
        spark,
        [("A", 100, 50, 20)],
        [("A", "x", 80, True, 0), ("A", "y", 60, False, 0), ("A", "y", 50, True, 5)],
    )["A"]
    assert (a.min_competitor_price, a.max_competitor_price, a.avg_competitor_price) == (80, 80, 80)
    assert a.competitor_count == 2
    assert a.avg_competitor_trend_pct == pytest.approx((0 + 0.2) / 2)
    assert a.price_delta_pct == 0.2 and a.needs_decision
    assert a.notes == "Overpriced vs market by 20.0%, trend +10.0%"


def test_no_in_stock_price_and_no_history(spark):
    a = analysis(spark, [("A", 100, 50, 20), ("B", 10, 5, 1)], [("A", "x", 80, False, 0)])
    for sku, count in (("A", 1), ("B", 0)):
        assert a[sku].avg_competitor_price is None and not a[sku].needs_decision
        assert a[sku].competitor_count == count and a[sku].avg_competitor_trend_pct is None
        assert a[sku].notes == "No in-stock competitor prices available"


def test_stale_competitor_still_counts_with_its_own_last_day(spark):
    a = analysis(
        spark, [("A", 100, 50, 20)], [("A", "x", 90, True, 40), ("A", "y", 110, True, 0)]
    )["A"]
    assert a.avg_competitor_price == 100 and not a.needs_decision


@pytest.mark.parametrize(
    "price, market_price, cost, flagged",
    [
        (100, 97, 50, True),  # gap of exactly 3 %
        (100, 97.01, 50, False),
        (100, 103, 90, True),  # underpriced: margin is not asked
        (100, 90, 80, False),  # overpriced, but the market leaves less than the margin
        (100, 90, 76.5, True),  # margin of exactly 15 %
    ],
)
def test_flag_rule_at_its_edges(spark, price, market_price, cost, flagged):
    a = analysis(spark, [("A", price, cost, 20)], [("A", "x", market_price, True, 0)])["A"]
    assert a.needs_decision is flagged


def test_guardrails_in_order(spark):
    c = catalog(spark, ("A", 100, 50, 10), ("B", 100, 50, 11), ("C", 100, 90, 5))
    steps = F.array(*[F.lit(p) for p in (75.0, 74.99, 125.0, 125.01)])
    tried = c.withColumn("candidate_price", F.explode(steps))
    found = {
        (r.sku, r.candidate_price): r.guardrail_violation
        for r in market.guardrail_check(tried).collect()
    }
    assert found["A", 75.0] == "none" and found["A", 74.99] == "exceeds_max_price_change"
    assert found["A", 125.0] == "low_stock_blocks_raise" and found["B", 125.0] == "none"
    assert found["B", 125.01] == "exceeds_max_price_change"
    assert found["C", 74.99] == "below_min_margin"


def test_float_bound_case_passes_in_cents(spark):
    df = spark.range(1).select(
        G.within_max_change(F.lit(166532), F.lit(208165)).alias("at"),
        G.within_max_change(F.lit(166532), F.lit(208166)).alias("over"),
    )
    assert tuple(df.first()) == (True, False)


def test_money_rounding(spark):
    df = spark.range(1).select(
        cents(F.lit(19.99)), half_up(F.lit(-5), F.lit(2)), exact_ratio(F.lit(-1), F.lit(16), 3),
        exact_ratio(F.lit(1), F.lit(0), 3),
    )
    assert tuple(df.first()) == (1999, -3, -0.063, None)


def test_daily_market_falls_back_to_all_prices(spark, rows):
    m = market.daily_market(
        prices(spark, ("A", "x", 10, False, 0), ("A", "y", 20, False, 0), ("B", "x", 10, True, 0), ("B", "y", 99, False, 0))
    )
    assert rows(m, "sku", "market_cents") == [("A", 1500.0), ("B", 1000.0)]


def test_trailing_window_is_seven_days(spark):
    t = market.trailing_trend(
        prices(spark, ("A", "x", 10, True, 7), ("A", "x", 20, True, 6), ("A", "x", 30, True, 0))
    )
    last = t.orderBy(F.col("date").desc()).first()
    assert (last.first_cents, last.latest_cents, last.points, last.trend_pct) == (2000, 3000, 2, 0.5)


def test_contract_names_the_wrong_columns(spark):
    bad = catalog(spark, ("A", 1, 1, 1)).drop("cost").withColumn("stock", F.lit("x"))
    with pytest.raises(schemas.ContractError, match="cost: missing.*stock: expected int"):
        market.analyze_market(bad, prices(spark, ("A", "x", 1, True, 0)))


def test_text_functions(spark):
    df = spark.createDataFrame([("DELL vortex-K57 (2026) k57 x1",)], "t string").select(
        text.words(F.col("t")), text.model_numbers(F.col("t")), text.first_word(F.lit("  Dell x"))
    )
    assert [list(v) if isinstance(v, list) else v for v in df.first()] == [
        ["2026", "dell", "k57", "vortex", "x1"], ["k57"], "dell",
    ]
    long = spark.range(1).select(
        text.collection_summary(F.sequence(F.lit(1), F.lit(21))), text.collection_summary(F.array(F.lit(1)))
    )
    assert tuple(long.first()) == ("<21 items>", "[1]")


def test_first_per_category_and_briefs(spark, rows):
    c = catalog(spark, ("A", 100, 50, 9, "c"), ("B", 100, 50, 9, "c"), ("C", 100, 50, 9, "d"))
    assert rows(market.first_per_category(c, 1), "sku") == [("A",), ("C",)]
    p = prices(spark, ("A", "x", 80, True, 3), ("A", "x", 88, True, 0))
    [(sku, brief)] = rows(market.product_briefs(c, market.analyze_market(c, p)))
    assert sku == "A" and "average $88.00, trend +10.0% (rising), 1 tracked" in brief
