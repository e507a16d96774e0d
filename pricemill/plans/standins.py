"""The engine's tables, derived from the star-schema and event tables of a data folder.

Each function is one deterministic projection or aggregate over a whole table. Money uses
integer arithmetic, so that any SQL engine computes the same values.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill import schemas
from pricemill.functions.money import cents, from_cents, half_up, whole_div
from pricemill.operators.market import analyze_market
from pricemill.sources.snapshots import PRICE_KEY, last_per_key

# Elasticity planted into the sales table, by category.
PLANTED_ELASTICITY = {
    "ECONOMY": -2.0,
    "MEDIUM": -2.4,
    "STANDARD": -2.8,
    "PROMO": -2.2,
    "SMALL": -1.8,
    "LARGE": -3.0,
}

# Dollars per million tokens in the call log.
IN_RATE, OUT_RATE = 15.0, 30.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _ext() -> Column:
    return cents(F.col("l_extendedprice"))


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    our = cents(F.col("p_retailprice"))
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    model = F.concat(
        F.char(F.lit(97) + k % 8), (F.lit(10) + whole_div(k, 8) % 90).cast("string")
    )
    return table(spark, folder, "part").select(
        k.alias("k"),
        k.cast("string").alias("sku"),
        F.concat_ws(" ", brand, "p_name", "p_type", model).alias("name"),
        brand.alias("brand"),
        F.col("p_type").alias("category"),
        our.alias("our_c"),
        whole_div(our * (F.lit(55) + k % 25), 100).alias("cost_c"),
        (k % 97).cast("int").alias("stock"),
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder).select(
        "sku",
        "name",
        "brand",
        "category",
        from_cents(F.col("our_c")).alias("our_price"),
        from_cents(F.col("cost_c")).alias("cost"),
        "stock",
    )


def _price_items(spark: SparkSession, folder: str) -> DataFrame:
    """Price points by part key, the price as a share of ours in hundredths of a percent."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("k"),
        (F.col("l_suppkey") % 4).alias("supplier_no"),
        (F.lit(8500) + _ext() % 3001).alias("share"),
        (F.col("l_returnflag") != "R").alias("in_stock"),
        F.to_date("l_shipdate").alias("date"),
        # a date holds one shipping time, so order and line tell its rows apart
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"),
    )


def _competitor_cents() -> Column:
    return whole_div(F.col("our_c") * F.col("share"), 10000)


def price_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Every received price point, corrections included, with its order of arrival."""
    parts = _parts(spark, folder).select("k", "sku", "our_c")
    return _price_items(spark, folder).join(parts, "k").select(
        "sku",
        F.col("supplier_no").cast("string").alias("competitor"),
        from_cents(_competitor_cents()).alias("price"),
        "in_stock",
        "date",
        "arrival",
    )


def prices(spark: SparkSession, folder: str) -> DataFrame:
    return last_per_key(price_feed(spark, folder), PRICE_KEY, ["arrival"]).drop("arrival")


def analysis(spark: SparkSession, folder: str) -> DataFrame:
    return analyze_market(catalog(spark, folder), prices(spark, folder))


def planted_elasticity(category: Column) -> Column:
    value = None
    for name, e in PLANTED_ELASTICITY.items():
        hit = category == name
        value = F.when(hit, F.lit(e)) if value is None else value.when(hit, F.lit(e))
    return value


def known_elasticity(spark: SparkSession, folder: str) -> DataFrame:
    categories = table(spark, folder, "part").select(F.col("p_type").alias("category")).distinct()
    return categories.withColumn("elasticity", planted_elasticity(F.col("category")))


def sales(spark: SparkSession, folder: str) -> DataFrame:
    parts = _parts(spark, folder).select("k", "sku", "category")
    base = (F.lit(20) + F.col("k") % 30).cast("double")
    gap = (_ext() % 1601 - 800).cast("double") / F.lit(10000.0)
    items = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("k"),
        gap.alias("gap"),
        (F.col("l_linenumber") % 3 - 1).cast("double").alias("noise"),
        (F.col("l_quantity") >= 46).alias("capped"),
    )
    wanted = F.lit(1.0) + planted_elasticity(F.col("category")) * F.col("gap")
    raw = F.floor(base * wanted + F.lit(0.5)).cast("double") + F.col("noise")
    return items.join(parts, "k").select(
        "sku",
        "category",
        "gap",
        F.when(F.col("capped"), F.least(base, raw)).otherwise(raw).alias("units"),
        "capped",
    )


def listings(spark: SparkSession, folder: str, received: DataFrame | None = None) -> DataFrame:
    """Price points under a competitor's own product names, plus products nobody carries.

    `received` may hold the rows of `prices`, where they are written already.

    The name's noise depends on the product: as it is, brand in capitals, words reversed, a
    marketing suffix, lower case; every seventh product has two letters swapped.
    """
    parts = _parts(spark, folder)
    k = F.col("k")
    rest = F.split(F.expr("substring(name, length(brand) + 2)"), " ")
    swapped = F.transform(
        rest,
        lambda w, i: F.when(
            (i == 1) & (k % 7 == 0),
            F.concat(
                F.substring(w, 1, 1), F.substring(w, 3, 1), F.substring(w, 2, 1), w.substr(F.lit(4), F.length(w))
            ),
        ).otherwise(w),
    )
    tail = F.concat_ws(" ", swapped)
    noisy = (
        F.when(k % 5 == 0, F.concat_ws(" ", "brand", tail))
        .when(k % 5 == 1, F.concat_ws(" ", F.upper("brand"), tail))
        .when(k % 5 == 2, F.concat_ws(" ", "brand", F.concat_ws(" ", F.reverse(swapped))))
        .when(k % 5 == 3, F.concat_ws(" ", "brand", tail, F.lit("(2026 Edition)")))
        .otherwise(F.lower(F.concat_ws(" ", "brand", tail)))
    )
    decoy = F.concat(F.col("brand"), F.lit(" zephyr lite z"), (F.lit(10) + k % 90).cast("string"))
    names = F.array(
        F.struct(noisy.alias("listing_name"), k.alias("true_k")),
        F.when(k % 10 == 0, F.struct(decoy.alias("listing_name"), F.lit(None).cast("long").alias("true_k"))),
    )
    # names are few bytes and much work, so the file's size would leave them to few tasks
    spread = parts.repartition(4 * spark.sparkContext.defaultParallelism)
    parts = spread.select("k", "sku", "our_c", F.array_compact(names).alias("names"))
    if received is not None:
        points = received.join(parts.select("k", "sku", "names"), "sku")
        return _listed(points.select("*", F.inline("names")), "k")
    # the last arrival of each product, as in `prices`, and of these that of the greatest key, both numbers in one
    order = k.cast("decimal(19,0)") * F.lit(Decimal(10**19)) + F.col("arrival").cast("decimal(19,0)")
    points = _price_items(spark, folder).join(parts.drop("sku"), "k").select(
        F.col("supplier_no").alias("competitor"),
        "date",
        "in_stock",
        _competitor_cents().alias("price"),
        order.alias("order"),
        F.inline("names"),
    )
    # nearly all keys of a file's part are different: met before they are hashed, rows are hashed in small shares
    found = _listed(points.repartition("competitor", "listing_name", "date"), "order")
    return found.withColumns({"competitor": F.col("competitor").cast("string"), "price": from_cents(F.col("price"))})


def _listed(points: DataFrame, order: str) -> DataFrame:
    """Price points under listing names: of those of one name, competitor and day, the last by `order`."""
    found = points.groupBy("competitor", "listing_name", "date").agg(
        F.max_by("price", order).alias("price"),
        F.max_by("in_stock", order).alias("in_stock"),
        F.max("true_k").cast("string").alias("true_sku"),
    )
    return found.select("competitor", "listing_name", "price", "in_stock", "date", "true_sku")


def suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Outside suggestions for most products; some out of range, some invalid."""
    k = F.col("k")
    return (
        _parts(spark, folder)
        .filter(k % 4 != 3)
        .select(
            "sku",
            F.when(k % 50 == 1, F.lit(0.0))
            .otherwise(from_cents(whole_div(F.col("our_c") * (F.lit(72) + k % 57), 100)))
            .alias("recommended_price"),
            ((F.lit(50) + k % 52).cast("double") / F.lit(100.0)).alias("confidence"),
            F.concat(F.lit("suggested for "), F.col("name")).alias("reasoning"),
        )
    )


def market_days(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded market per (sku, day) with what the strategies need to price it."""
    listed = F.when(F.col("in_stock"), F.col("c"))
    days = (
        prices(spark, folder)
        .select("sku", "date", "in_stock", cents(F.col("price")).alias("c"))
        .groupBy("sku", F.col("date").alias("day"))
        .agg(
            F.count(listed).alias("n_in"),
            F.sum(listed).alias("sum_in"),
            F.count(F.lit(1)).alias("n"),
            F.sum("c").alias("total"),
        )
    )
    market = F.when(F.col("n_in") > 0, half_up(F.col("sum_in"), F.nullif("n_in", F.lit(0)))).otherwise(
        half_up(F.col("total"), F.col("n"))
    )
    parts = _parts(spark, folder).select(
        "sku",
        "our_c",
        "cost_c",
        "stock",
        planted_elasticity(F.col("category")).alias("elasticity"),
        (F.lit(20) + F.col("k") % 30).cast("double").alias("base_demand"),
    )
    return days.select("sku", "day", market.alias("market_c")).join(parts, "sku")


def _event_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string")).alias("run_id"),
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def tool_events(spark: SparkSession, folder: str) -> DataFrame:
    return _event_rows(spark, folder).select(
        "timestamp", "run_id", F.lit("tool").alias("agent"), (F.col("event_type") != "error").alias("success")
    )


def audit_events(spark: SparkSession, folder: str) -> DataFrame:
    """Audit log: a tool event per row, and a decision event for purchases and clicks."""
    k, e = F.col("k"), F.col("event_id")

    def rec(j: int, source: Column) -> Column:
        return F.struct(
            (e * 3 + j).cast("string").alias("sku"),
            (F.lit(80) + (k * 7 + j * 13) % 60).cast("double").alias("recommended_price"),
            source.alias("source"),
            F.when((e + j) % 11 != 0, F.lit(90.0)).alias("min_competitor_price"),
            F.lit(110.0).alias("max_competitor_price"),
            F.when((k + j) % 5 != 0, ((k + j * 3) % 40 - 20).cast("double") / F.lit(1000.0)).alias(
                "avg_competitor_trend_pct"
            ),
        )

    recs = F.array(
        rec(0, F.lit(None).cast("string")), rec(1, F.lit("optimizer")), rec(2, F.lit("llm"))
    )
    attempts = F.lit(1) + k % 5

    def payload(success=None, attempts=None, successes=None, recs=None) -> Column:
        def typed(value, name):
            kind = schemas.EVENT_DATA[name].dataType
            return (F.lit(None) if value is None else value).cast(kind).alias(name)

        return F.struct(
            typed(success, "success"),
            typed(k if success is not None else None, "latency_ms"),
            typed(attempts, "generate_attempts"),
            typed(successes, "generate_successes"),
            typed(recs, "recommendations"),
        )

    def event(agent: str, name: Column, data: Column) -> Column:
        return F.struct(F.lit(agent).alias("agent"), name.alias("event"), data.alias("data"))

    tool = event("tool", F.col("event_type"), payload(success=F.col("event_type") != "error"))
    batch = event("decision", F.lit("batch_complete"), payload(recs=recs))
    stats = event(
        "decision",
        F.lit("llm_stats"),
        payload(attempts=attempts, successes=F.least(attempts, k % 4)),
    )
    kinds = (
        F.when(F.col("event_type") == "purchase", F.array(tool, batch))
        .when(F.col("event_type") == "click", F.array(tool, stats))
        .otherwise(F.array(tool))
    )
    return _event_rows(spark, folder).select(
        "timestamp",
        "run_id",
        F.inline_outer(kinds),
    ).withColumn("latency_ms", F.col("data.latency_ms"))


def call_log(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts of each request: up to three per model, two models; errors may fail on both, or be stopped."""
    k, failed = F.col("k"), F.col("event_type") == "error"
    attempts = (
        F.when(failed & (k % 2 == 0), 4)
        .when(failed & (k % 10 == 9), 5)
        .when(failed, 6)
        .otherwise((F.lit(1) + k % 3).cast("int"))
    )
    rows = (
        _event_rows(spark, folder)
        .withColumn("n", attempts)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    )
    i = F.col("i")
    ok = (i == F.col("n") - 1) & ~(failed & (k % 2 == 1))
    lost = ~ok & (i % 2 == 1)
    return rows.select(
        "run_id",
        (F.col("event_id") * 10 + i).alias("seq"),
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("request_key"),
        F.concat(F.lit("m"), whole_div(i, 3).cast("string")).alias("model"),
        whole_div(i, 3).cast("int").alias("model_rank"),
        (i % 3 + 1).alias("attempt"),
        ok.alias("ok"),
        F.when(~lost, F.lit(500) + k * 3 + i).alias("tokens_in"),
        F.when(~lost, F.lit(50) + k).alias("tokens_out"),
        (k * 10 + i).alias("latency_ms"),
    )


def call_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every request made; purchases ask the same thing twice."""
    times = F.when(F.col("event_type") == "purchase", 2).otherwise(1)
    return _event_rows(spark, folder).select(
        "run_id",
        F.col("event_id").alias("seq"),
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("request_key"),
        F.explode(F.sequence(F.lit(1), times)).alias("_time"),
    ).drop("_time")


def queued_items(spark: SparkSession, folder: str) -> DataFrame:
    return _event_rows(spark, folder).select(
        "run_id",
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("sku"),
        F.col("timestamp").alias("created_at"),
    )


def human_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to the queued items: none for views, a second, opposite one for signups."""
    k, kind = F.col("k"), F.col("event_type")

    def answer(approved: Column, seconds: Column) -> Column:
        return F.struct(
            approved.alias("approved"),
            (F.col("timestamp") + F.make_dt_interval(secs=seconds)).alias("decided_at"),
        )

    one = answer(kind != "error", k * 7)
    two = answer(kind == "error", k * 7 + 40)
    answers = (
        F.when(kind == "view", F.array().cast("array<struct<approved:boolean,decided_at:timestamp>>"))
        .when(kind == "signup", F.array(one, two))
        .otherwise(F.array(one))
    )
    return _event_rows(spark, folder).select(
        "run_id",
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("sku"),
        F.inline(answers),
    )


def dirty_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Price feed with planted faults: prices of 0, products that are not in the catalog."""
    feed = price_feed(spark, folder)
    order = whole_div(F.col("arrival"), 10)
    return feed.select(
        F.when(order % 503 == 0, F.concat(F.lit("x"), F.col("sku"))).otherwise(F.col("sku")).alias("sku"),
        "competitor",
        F.when(order % 501 == 0, F.lit(0.0)).otherwise(F.col("price")).alias("price"),
        F.when(order % 509 != 0, F.col("in_stock")).alias("in_stock"),
        "date",
        "arrival",
    )


def late_prices(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The price feed in two deliveries: lines up to the fourth of an order, and the later ones."""
    feed = price_feed(spark, folder)
    line = F.col("arrival") % 10
    return feed.filter(line <= 4), feed.filter(line > 4)


def damaged_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Tool events, some with a payload that breaks off, and lines that are no JSON: (events, (run_id, value))."""
    rows = _event_rows(spark, folder)
    payload = F.to_json(
        F.struct((F.col("event_type") != "error").alias("success"), F.col("k").cast("double").alias("latency_ms"))
    )
    events = rows.select(
        "timestamp",
        "run_id",
        F.lit("tool").alias("agent"),
        F.col("event_type").alias("event"),
        F.when(F.col("event_id") % 41 == 0, F.lit('{"success": tru')).otherwise(payload).alias("data"),
        F.col("k").cast("double").alias("latency_ms"),
    )
    lines = rows.filter(F.col("event_id") % 37 == 0).select(
        "run_id", F.concat(F.lit('{"timestamp": broken '), F.col("event_id").cast("string")).alias("value")
    )
    return events, lines


def faulty_tables(
    spark: SparkSession, folder: str, recommended: DataFrame, received: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All six tables that have rules, with planted faults; `received` as in `listings`."""
    n = F.col("sku").cast("long")
    c = catalog(spark, folder)
    return {
        "catalog": c.withColumns(
            {
                "our_price": F.when(n % 13 != 0, F.col("our_price")),
                "cost": F.when(n % 17 != 0, F.col("cost")).otherwise(0.0),
                "stock": F.when(n % 19 != 0, F.col("stock")).otherwise(-1),
            }
        ),
        "prices": dirty_prices(spark, folder),
        "listings": listings(spark, folder, received).withColumns(
            {
                "price": F.when(F.dayofmonth("date") != 13, F.col("price")).otherwise(0.0),
                "in_stock": F.when(F.dayofmonth("date") != 17, F.col("in_stock")),
            }
        ),
        "suggestions": suggestions(spark, folder),
        "recommendations": recommended.withColumns(
            {
                "guardrail_violation": F.when(n % 7 != 0, F.col("guardrail_violation")).otherwise("odd"),
                "confidence": F.when(n % 11 != 0, F.col("confidence")).otherwise(2.0),
            }
        ),
        "pending": recommended.select(
            F.when(n % 3 != 0, F.lit("r1")).alias("run_id"),
            "sku",
            "current_price",
            "recommended_price",
            "confidence",
            F.when(n % 5 != 0, F.lit("pending")).otherwise("lost").alias("status"),
        ),
    }


def unbranded_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listings that name no known brand: without one, or with its first two letters swapped; some with a typo more."""
    parts = _parts(spark, folder)
    k = F.col("k")
    words = F.split(F.expr("substring(name, length(brand) + 2)"), " ")
    swapped = F.transform(
        words, lambda w, i: F.when((i == 1) & (k % 4 == 1), F.concat(w, F.lit("x"))).otherwise(w)
    )
    odd_brand = F.concat(F.lit("q"), F.col("brand"))
    name = F.when(k % 2 == 0, F.concat_ws(" ", swapped)).otherwise(F.concat_ws(" ", odd_brand, F.concat_ws(" ", swapped)))
    return parts.filter(k % 20 == 3).select(name.alias("listing_name")).union(
        parts.filter(k % 20 == 6).select(F.concat_ws(" ", swapped).alias("listing_name"))
    )
