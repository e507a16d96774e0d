"""Where each product stands against the market."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemill import schemas
from pricemill.functions import guardrails as G
from pricemill.functions import text
from pricemill.functions.money import BP, cents, exact_ratio, from_cents, half_up
from pricemill.params import DEFAULT_POLICY, Policy


def competitor_positions(prices: DataFrame) -> DataFrame:
    """Latest price, latest stock flag and trend per (sku, competitor).

    Each competitor's own last day counts, however old. Only fixed-width aggregation buffers
    are used, so the hash aggregate runs before the shuffle too and a hot pair leaves each map
    task as one row.
    """
    points = prices.select("sku", "competitor", "date", "in_stock", cents(F.col("price")).alias("c"))
    pairs = points.groupBy("sku", "competitor").agg(
        F.max_by("c", "date").alias("latest_cents"),
        F.min_by("c", "date").alias("first_cents"),
        F.max_by("in_stock", "date").alias("in_stock"),
        F.max("date").alias("latest_date"),
        F.min("date").alias("first_date"),
        F.count(F.lit(1)).alias("points"),
    )
    change = (F.col("latest_cents") - F.col("first_cents")) / F.col("first_cents")
    return pairs.withColumn(
        "trend_pct",
        F.when(F.col("latest_date") > F.col("first_date"), change).otherwise(F.lit(0.0)),
    )


def market_stats(positions: DataFrame) -> DataFrame:
    """Per SKU: price stats over in-stock competitors, trend and count over all of them."""
    listed = F.when(F.col("in_stock"), F.col("latest_cents"))
    return positions.groupBy("sku").agg(
        F.count(F.lit(1)).alias("competitor_count"),
        F.count(listed).alias("in_stock_count"),
        F.sum(listed).alias("in_stock_sum"),
        F.min(listed).alias("min_cents"),
        F.max(listed).alias("max_cents"),
        F.avg("trend_pct").alias("trend"),
    )


def analyze_market(
    catalog: DataFrame, prices: DataFrame, policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """One row per catalog SKU: market prices, gap, trend, and whether a decision is needed.

    The flag compares whole cents without dividing: with n in-stock prices that sum to s, the
    gap our - s/n is tested as our*n - s.
    """
    schemas.require(catalog, schemas.CATALOG, "catalog")
    schemas.require(prices, schemas.PRICES, "prices")
    stats = market_stats(competitor_positions(prices))
    joined = (
        catalog.select(
            "sku",
            "category",
            "stock",
            cents(F.col("our_price")).alias("our"),
            cents(F.col("cost")).alias("unit_cost"),
        )
        .join(stats, "sku", "left")
        .withColumn("n", F.coalesce("in_stock_count", F.lit(0)))
        .withColumn("gap_num", F.col("our") * F.col("n") - F.col("in_stock_sum"))
        .withColumn("gap_den", F.col("our") * F.col("n"))
    )
    gap_num, gap_den, total = F.col("gap_num"), F.col("gap_den"), F.col("in_stock_sum")
    has_market = F.col("n") > 0
    wide_gap = F.abs(gap_num) * BP >= gap_den * policy.flag_gap_bp
    cost_total = F.col("unit_cost") * F.col("n")
    room = (gap_num <= 0) | G.keeps_margin(total, cost_total, policy)
    average = half_up(total, F.nullif(F.col("n"), F.lit(0)))
    # fixed value: the note of a product without a market
    note = F.when(has_market, text.market_note(gap_num, gap_den, F.col("trend"))).otherwise(
        "No in-stock competitor prices available"
    )
    return joined.select(
        "sku",
        "category",
        from_cents(F.col("our")).alias("our_price"),
        from_cents(F.col("unit_cost")).alias("cost"),
        "stock",
        from_cents(F.col("min_cents")).alias("min_competitor_price"),
        from_cents(F.col("max_cents")).alias("max_competitor_price"),
        from_cents(average).alias("avg_competitor_price"),
        exact_ratio(gap_num, gap_den, 4).alias("price_delta_pct"),
        F.when(has_market, F.round("trend", 4)).alias("avg_competitor_trend_pct"),
        G.margin(F.col("our"), F.col("unit_cost")).alias("current_margin_pct"),
        F.coalesce("competitor_count", F.lit(0)).alias("competitor_count"),
        F.coalesce(has_market & wide_gap & room, F.lit(False)).alias("needs_decision"),
        note.alias("notes"),
    )


def daily_market(prices: DataFrame) -> DataFrame:
    """Market price per (sku, day): mean of the in-stock prices, else of all prices."""
    listed = F.when(F.col("in_stock"), F.col("c"))
    days = (
        prices.select("sku", "date", "in_stock", cents(F.col("price")).alias("c"))
        .groupBy("sku", "date")
        .agg(
            F.count(listed).alias("n_in"),
            F.sum(listed).alias("sum_in"),
            F.count(F.lit(1)).alias("n_all"),
            F.sum("c").alias("sum_all"),
        )
    )
    mean = F.coalesce(
        F.col("sum_in") / F.nullif(F.col("n_in"), F.lit(0)), F.col("sum_all") / F.col("n_all")
    )
    return days.select("sku", "date", mean.alias("market_cents"))


def trailing_trend(prices: DataFrame, days: int = DEFAULT_POLICY.trailing_days) -> DataFrame:
    """Position of each (sku, competitor) over the trailing days, for every as-of day at once.

    A window partition holds at most one row per calendar day, so its size is bounded.
    """
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    points = prices.select(
        "sku", "competitor", "date", "in_stock", cents(F.col("price")).alias("c"), day.alias("_day")
    )
    trailing = (
        Window.partitionBy("sku", "competitor").orderBy("_day").rangeBetween(-(days - 1), 0)
    )
    spans = points.select(
        "sku",
        "competitor",
        "date",
        "in_stock",
        F.first("c").over(trailing).alias("first_cents"),
        F.col("c").alias("latest_cents"),
        F.count(F.lit(1)).over(trailing).alias("points"),
    )
    moved = F.col("latest_cents") - F.col("first_cents")
    return spans.withColumn("trend_pct", moved / F.col("first_cents"))


def stats_as_of(prices: DataFrame, days: int = DEFAULT_POLICY.trailing_days) -> DataFrame:
    """Trailing market stats per (sku, as-of day), from the competitors seen that day."""
    listed = F.when(F.col("in_stock"), F.col("latest_cents"))
    return (
        trailing_trend(prices, days)
        .groupBy("sku", "date")
        .agg(
            F.count(F.lit(1)).alias("competitor_count"),
            F.count(listed).alias("in_stock_count"),
            F.sum(listed).alias("in_stock_sum"),
            F.avg("trend_pct").alias("trend"),
        )
    )


def catalog_profile(catalog: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Per category: rows, mean margin, products at or below the low-stock level."""
    our, cost = cents(F.col("our_price")), cents(F.col("cost"))
    return catalog.groupBy("category").agg(
        F.count(F.lit(1)).alias("skus"),
        F.round(F.avg(G.margin(our, cost)), 4).alias("mean_margin_pct"),
        F.count_if(F.col("stock") <= policy.low_stock_units).alias("low_stock"),
    )


def first_per_category(catalog: DataFrame, n: int = 5) -> DataFrame:
    """The first n products of each category in SKU order."""
    order = Window.partitionBy("category").orderBy("sku")
    return (
        catalog.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")
    )


def guardrail_check(
    rows: DataFrame, price_column: str = "candidate_price", policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Adds each guardrail's verdict on a proposed price to rows that carry catalog columns."""
    p, cur, cost = cents(F.col(price_column)), cents(F.col("our_price")), cents(F.col("cost"))
    return rows.select(
        "*",
        G.keeps_margin(p, cost, policy).alias("margin_ok"),
        G.within_max_change(cur, p, policy).alias("change_ok"),
        G.stock_allows(cur, p, F.col("stock"), policy).alias("stock_ok"),
        G.first_violation(cur, p, cost, F.col("stock"), policy).alias("guardrail_violation"),
    )


def product_briefs(
    catalog: DataFrame, analysis: DataFrame, policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Text brief of each flagged product for a human or an outside model."""
    a = analysis.filter("needs_decision").select(
        "sku",
        "our_price",
        "cost",
        "min_competitor_price",
        "max_competitor_price",
        "avg_competitor_price",
        F.coalesce("avg_competitor_trend_pct", F.lit(0.0)).alias("trend"),
        "competitor_count",
    )
    tenths = F.round(F.col("trend") * F.lit(1000.0)).cast("long")
    body = F.format_string(
        "Product %s (%s): our price $%.2f, cost $%.2f, minimum margin %d%%. "
        "Competitors in stock: min $%.2f, max $%.2f, average $%.2f, trend %s (%s), %d tracked. "
        "Keep the margin and change the price by at most %d%%.",
        "sku",
        "name",
        "our_price",
        "cost",
        F.lit(policy.min_margin_bp // 100),
        "min_competitor_price",
        "max_competitor_price",
        "avg_competitor_price",
        text.signed_tenths_text(tenths),
        text.trend_class(F.col("trend"), policy.trend_class_limit),
        "competitor_count",
        F.lit(policy.max_change_bp // 100),
    )
    return a.join(catalog.select("sku", "name"), "sku").select("sku", body.alias("brief"))
