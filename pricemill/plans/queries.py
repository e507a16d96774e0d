"""The operators under their public names, each over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill.functions import guardrails as G
from pricemill.functions import text as X
from pricemill.functions.money import cents, from_cents
from pricemill.operators import approval, calls, candidates, constraints, elasticity, market
from pricemill.operators import matching, metrics, optimizer, recommendations, scorecard
from pricemill.params import DEFAULT_POLICY
from pricemill.plans import daily_run, ingestion
from pricemill.plans import standins as S
from pricemill.session import checkpoint_dir, staged
from pricemill.sources import audit_log, reference_data, snapshots, stored_tables, tables
from pricemill.sources.reference_data import with_elasticity
from pricemill.streaming import approvals as stream_approvals
from pricemill.streaming import audit_rate, price_feed

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


# --- scans, checks, market analysis ------------------------------------------------------


@query
def market_analysis(spark, folder):
    a = S.analysis(spark, folder)
    return a.withColumn("current_margin_pct", F.round("current_margin_pct", 6))


@query
def flagged_market(spark, folder):
    return S.analysis(spark, folder).filter("needs_decision").select(
        "sku", "our_price", "avg_competitor_price", "price_delta_pct", "notes"
    )


@query
def competitor_trend(spark, folder):
    p = market.competitor_positions(S.prices(spark, folder))
    return p.select(
        "sku",
        "competitor",
        from_cents(F.col("latest_cents")).alias("latest_price"),
        "in_stock",
        "points",
        F.round("trend_pct", 6).alias("trend_pct"),
    )


@query
def market_price_daily(spark, folder):
    days = market.daily_market(S.prices(spark, folder))
    return days.select("sku", "date", F.round("market_cents", 4).alias("market_cents"))


@query
def trailing_trend(spark, folder):
    rows = market.trailing_trend(S.prices(spark, folder))
    return rows.withColumn("trend_pct", F.round("trend_pct", 6)).drop("in_stock")


@query
def trailing_market(spark, folder):
    return market.stats_as_of(S.prices(spark, folder)).withColumn("trend", F.round("trend", 6))


@query
def guardrail_eval(spark, folder):
    """Each competitor price tested as a new price of ours."""
    rows = S.prices(spark, folder).select(
        "sku", "competitor", "date", F.col("price").alias("candidate_price")
    )
    checked = market.guardrail_check(
        rows.join(S.catalog(spark, folder).select("sku", "our_price", "cost", "stock"), "sku")
    )
    return checked.drop("our_price", "cost", "stock")


@query
def guard_bounds(spark, folder):
    c = S.catalog(spark, folder)
    low, high = G.guard_bounds(cents(F.col("cost")), cents(F.col("our_price")))
    return c.select(
        "sku",
        from_cents(low).alias("low"),
        from_cents(high).alias("high"),
        G.projected_margin(cents(F.col("our_price")), cents(F.col("cost"))).alias("margin"),
    )


@query
def catalog_profile(spark, folder):
    return market.catalog_profile(S.catalog(spark, folder))


@query
def missing_skus(spark, folder):
    """Products that no competitor has in stock at its latest price."""
    listed = market.competitor_positions(S.prices(spark, folder)).filter("in_stock")
    return tables.missing_skus(S.catalog(spark, folder), listed)


@query
def research_summary(spark, folder):
    listed = market.competitor_positions(S.prices(spark, folder)).filter("in_stock")
    return tables.research_summary(S.catalog(spark, folder), listed)


@query
def history_of_flagged(spark, folder):
    flagged = S.analysis(spark, folder).filter("needs_decision")
    return tables.prices_for_skus(S.prices(spark, folder), flagged)


@query
def sku_lookup(spark, folder):
    return tables.prices_for_sku(S.prices(spark, folder), "42")


@query
def distinct_days(spark, folder):
    return tables.distinct_sorted(S.prices(spark, folder), "date", "competitor")


@query
def constraint_violations(spark, folder):
    checked = constraints.with_violations(S.dirty_prices(spark, folder), constraints.price_rules())
    return checked.filter(F.size("violations") > 0).select(
        "sku", "competitor", "date", "arrival", F.concat_ws(",", "violations").alias("violations")
    )


@query
def duplicate_price_keys(spark, folder):
    return constraints.duplicate_keys(S.price_feed(spark, folder), snapshots.PRICE_KEY)


@query
def orphan_prices(spark, folder):
    rows = constraints.orphans(S.dirty_prices(spark, folder), S.catalog(spark, folder))
    return rows.select("sku", "competitor", "date", "arrival")


@query
def latest_upsert(spark, folder):
    return S.prices(spark, folder)


@query
def catalog_upsert(spark, folder):
    """Catalog after suggested prices were merged in as new catalog rows."""
    c = S.catalog(spark, folder)
    changed = c.join(S.suggestions(spark, folder).filter("recommended_price > 0"), "sku").withColumn(
        "our_price", F.col("recommended_price")
    )
    return snapshots.upsert(c, changed, snapshots.CATALOG_KEY, ["confidence"])


@query
def stored_price_upsert(spark, folder):
    """A stored price table after a second delivery was merged in, read back from its folders."""
    first, second = S.late_prices(spark, folder)
    path, spread = _folder(spark, "stored-prices"), ("date",)
    initial = snapshots.last_per_key(first, snapshots.PRICE_KEY, ["arrival"]).drop("arrival")
    stored_tables.create_stored(initial, path, spread)
    stored_tables.upsert_stored(path, second, snapshots.PRICE_KEY, spread, ["arrival"])
    return stored_tables.read_stored(spark, path)


@query
def run_log_events(spark, folder):
    """One run's events out of a log of many runs, with the lines and payloads that do not decode."""
    events, lines = S.damaged_log(spark, folder)
    path = _folder(spark, "log")
    audit_log.append_events(events, path)
    lines.write.mode("append").partitionBy("run_id").text(path)
    found = audit_log.read_log(spark, path, "r7")
    return found.select(
        "run_id", "agent", "event", F.col("data.success").alias("success"), F.col("data.latency_ms").alias("payload_ms"),
        "latency_ms", "damaged",
    )


@query
def catalog_csv(spark, folder):
    """The catalog written as CSV, its columns in another order and one more, and read back by name."""
    path = _folder(spark, "catalog-csv")
    wide = S.catalog(spark, folder).withColumn("remark", F.lit('kept "as is", not read'))
    wide.select(*sorted(wide.columns, reverse=True)).write.option("header", True).csv(path)
    return tables.read_catalog_csv(spark, path)


@query
def elasticity_lookup(spark, folder):
    """Elasticity per product from a stored file without some categories, and from a file never written."""
    path = _folder(spark, "elasticity")
    some = S.known_elasticity(spark, folder).filter(~F.col("category").isin("MEDIUM", "LARGE"))
    reference_data.write_elasticity(some, path)
    products = S.catalog(spark, folder).select("sku", "category")
    stored = with_elasticity(products, reference_data.read_elasticity(spark, path))
    nothing = reference_data.read_elasticity(spark, _folder(spark, "never-written"))
    return with_elasticity(stored.withColumnRenamed("elasticity", "stored"), nothing).withColumnRenamed(
        "elasticity", "without_file"
    )


def _rule_tables(spark, folder):
    rules = {
        "catalog": constraints.catalog_rules(),
        "prices": constraints.price_rules(),
        "listings": constraints.listing_rules(),
        "suggestions": constraints.suggestion_rules(),
        "recommendations": constraints.recommendation_rules(),
        "pending": constraints.pending_rules(),
    }
    received = staged(S.prices(spark, folder), "prices")
    flagged = market.analyze_market(S.catalog(spark, folder), received).filter("needs_decision")
    made = recommendations.recommend_from_suggestions(flagged, S.suggestions(spark, folder))
    faulty = S.faulty_tables(spark, folder, staged(made.accepted, "recommended"), received)
    return constraints.rule_counts({name: (faulty[name], rules[name]) for name in rules})


@query
def rule_counts(spark, folder):
    """Rows and violations of every rule of all six tables, counted in the pass that checks them."""
    return _rule_tables(spark, folder)[0]


@query
def rule_violations(spark, folder):
    """One row per product or competitor, table and broken rule, over all six tables."""
    _, marked = _rule_tables(spark, folder)
    rows = None
    for name, table in marked.items():
        key = F.col("sku" if "sku" in table.columns else "competitor").alias("key")
        found = table.select(F.lit(name).alias("table"), key, F.explode("violations").alias("rule"))
        found = found.groupBy("table", "key", "rule").agg(F.count(F.lit(1)).alias("broken"))
        rows = found if rows is None else rows.unionByName(found)
    return rows


@query
def first_n_per_category(spark, folder):
    return market.first_per_category(S.catalog(spark, folder), 5).select("category", "sku", "name")


@query
def product_briefs(spark, folder):
    return market.product_briefs(S.catalog(spark, folder), S.analysis(spark, folder))


# --- elasticity and pricing --------------------------------------------------------------


@query
def elasticity_estimates(spark, folder):
    return elasticity.estimate_elasticity(S.sales(spark, folder))


@query
def sku_elasticity(spark, folder):
    fits = elasticity.sku_fits(S.sales(spark, folder))
    return fits.select("sku", "category", "observations", F.round("elasticity", 4).alias("elasticity"))


@query
def merged_elasticity(spark, folder):
    """Fits from stored sums of three batches of sales, one of them delivered twice."""
    sales, path = S.sales(spark, folder), _folder(spark, "sales-sums")
    batch = F.pmod(F.xxhash64("sku", "gap", "units"), F.lit(3))
    for k in (0, 1, 2, 1):
        elasticity.append_sales(sales.filter(batch == k), path, f"b{k}")
    fits = elasticity.fits_from_sums(elasticity.stored_sums(spark, path))
    return fits.select("sku", "category", "observations", F.round("elasticity", 4).alias("elasticity"))


@query
def elasticity_error(spark, folder):
    estimates = elasticity.estimate_elasticity(S.sales(spark, folder))
    return elasticity.estimation_error(estimates, S.known_elasticity(spark, folder))


@query
def elasticity_mean_error(spark, folder):
    estimates = elasticity.estimate_elasticity(S.sales(spark, folder))
    return elasticity.mean_abs_error(estimates, S.known_elasticity(spark, folder))


@query
def sales_gaps(spark, folder):
    """Our own daily price points placed against the market of the day."""
    parts = S.catalog(spark, folder)
    p = S.prices(spark, folder)
    sold = (
        p.groupBy("sku", "date")
        .agg(F.count(F.lit(1)).alias("units"))
        .join(parts.select("sku", "category", F.col("our_price").alias("price"), "stock"), "sku")
    )
    rows = elasticity.sales_observations(sold, p)
    return rows.groupBy("sku", "category").agg(
        F.count(F.lit(1)).alias("days"),
        F.round(F.avg("gap"), 6).alias("mean_gap"),
        F.count_if("capped").alias("capped_days"),
    )


def _problems(spark, folder):
    """Every product with a market, priced against its average."""
    rows = with_elasticity(S.analysis(spark, folder), S.known_elasticity(spark, folder))
    return candidates.pricing_problems(
        rows.withColumnsRenamed(
            {"our_price": "current_price", "avg_competitor_price": "reference_price"}
        )
    )


@query
def price_candidates(spark, folder):
    rows = candidates.price_candidates(_problems(spark, folder))
    return rows.withColumns({c: F.round(c, 3) for c in ("units", "value", "spend")})


@query
def optimum_price(spark, folder):
    best = candidates.optimum_prices(_problems(spark, folder))
    return best.withColumns({c: F.round(c, 3) for c in ("value", "spend")})


@query
def revenue_optimum_price(spark, folder):
    policy = replace(DEFAULT_POLICY, objective="revenue", grid_points=11)
    best = candidates.optimum_prices(_problems(spark, folder), policy)
    return best.withColumns({c: F.round(c, 3) for c in ("value", "spend")})


def _joint(spark, folder):
    a = staged(S.analysis(spark, folder), "analysis")
    together, _ = recommendations.flagged_groups(a)
    problems = recommendations.joint_problems(together, S.known_elasticity(spark, folder))
    return optimizer.optimize_prices(problems)


@query
def optimized_prices(spark, folder):
    joint = _joint(spark, folder)
    return joint.prices.withColumns({c: F.round(c, 3) for c in ("value", "spend")})


@query
def optimized_categories(spark, folder):
    joint = _joint(spark, folder)
    return joint.categories.withColumns(
        {c: F.round(c, 2) for c in ("value", "spend", "budget", "gap")}
    )


def _tight(spark, folder):
    """A small part of the usual discount budget, so that it binds."""
    policy = replace(DEFAULT_POLICY, discount_budget_bp=2)
    return optimizer.optimize_prices(_problems(spark, folder), policy=policy)


@query
def tight_budget_categories(spark, folder):
    joint = _tight(spark, folder)
    return joint.categories.withColumns(
        {c: F.round(c, 2) for c in ("value", "spend", "budget", "gap")}
    )


@query
def tight_budget_prices(spark, folder):
    prices = _tight(spark, folder).prices
    return prices.withColumns({c: F.round(c, 3) for c in ("value", "spend")})


@query
def joint_recommendations(spark, folder):
    a = staged(S.analysis(spark, folder), "analysis")
    together, _ = recommendations.flagged_groups(a)
    made = recommendations.recommend_jointly(together, S.known_elasticity(spark, folder))
    return made.accepted


def _suggested(spark, folder):
    flagged = S.analysis(spark, folder).filter("needs_decision")
    return recommendations.recommend_from_suggestions(flagged, S.suggestions(spark, folder))


@query
def suggestion_recs(spark, folder):
    return _suggested(spark, folder).accepted


@query
def sanity_rejections(spark, folder):
    return _suggested(spark, folder).rejected.select(
        "sku", "current_price", "recommended_price", "reason"
    )


# --- listing ingestion -------------------------------------------------------------------


@query
def model_numbers(spark, folder):
    names = matching.distinct_listings(S.listings(spark, folder))
    return names.select("listing_name", F.concat_ws(",", "models").alias("models"))


@query
def brand_blocking(spark, folder):
    names = matching.distinct_listings(S.listings(spark, folder))
    return matching.brand_blocks(names, S.catalog(spark, folder)).select("listing_name", "block")


@query
def listing_containment(spark, folder):
    """Per listing text: how many product names include it or are included by it."""
    c = S.catalog(spark, folder)
    blocked = matching.brand_blocks(matching.distinct_listings(S.listings(spark, folder)), c)
    texts = staged(blocked.select("block", F.concat_ws(" ", "words").alias("text_key")).distinct(), "texts")
    names = staged(matching.name_groups(c, DEFAULT_POLICY.shortlist, blocks=texts.select("block")), "names")
    # the product names are looked up in their own shuffle: a broadcast of them would go through the driver
    pairs = matching.containment_pairs(texts, names).join(names.hint("merge"), ["block", "name_key"])
    return pairs.groupBy("block", "text_key").agg(
        F.count(F.lit(1)).alias("names"), F.min("first_sku").alias("first_sku")
    )


@query
def listing_matches(spark, folder):
    names = matching.distinct_listings(S.listings(spark, folder))
    m = matching.match_names(names, S.catalog(spark, folder))
    return m.withColumn("match_score", F.round("match_score", 6))


@query
def unbranded_matches(spark, folder):
    """Listings that name no known brand: every product is a candidate."""
    names = matching.distinct_listings(S.unbranded_listings(spark, folder))
    m = matching.match_names(names, S.catalog(spark, folder))
    return m.withColumn("match_score", F.round("match_score", 6))


def _ingested(spark, folder):
    received = staged(S.listings(spark, folder), "received")
    return ingestion.ingest_listings(received, S.catalog(spark, folder))


@query
def ingested_prices(spark, folder):
    return _ingested(spark, folder).prices


@query
def published_prices(spark, folder):
    """Prices of the second of two refreshes of listings and prices, read back as published."""
    root, received = _folder(spark, "published"), staged(S.listings(spark, folder), "received")
    some = received.filter(F.xxhash64("listing_name") % 2 == 0)
    for listings in (some, received):
        ingestion.publish_refresh(ingestion.ingest_listings(listings, S.catalog(spark, folder)), root)
    return stored_tables.read_published(spark, root, "prices")["prices"]


@query
def matching_quality(spark, folder):
    return _ingested(spark, folder).quality


# --- approval, audit, daily run ----------------------------------------------------------


def _routed(spark, folder):
    return approval.route(suggestion_recs(spark, folder))


@query
def routing(spark, folder):
    return _routed(spark, folder).select("sku", "guardrail_violation", "reversible", "outcome")


@query
def routing_totals(spark, folder):
    return approval.routing_totals(_routed(spark, folder))


@query
def outcome_counts(spark, folder):
    return approval.outcome_counts(_routed(spark, folder))


@query
def review_queue(spark, folder):
    """The queue after two runs appended what they escalated, the second one only what a guardrail blocks."""
    path, routed = _folder(spark, "queue"), staged(_routed(spark, folder), "routed")
    for run, rows in (("first", routed), ("second", routed.filter("guardrail_violation <> 'none'"))):
        reference_data.append_pending(approval.to_queue(rows, run), path)
    stored = reference_data.read_pending(spark, path)
    now = F.current_timestamp()
    return stored.withColumn("stamped", F.col("created_at").between(now - F.make_interval(hours=F.lit(1)), now)).drop(
        "created_at"
    )


@query
def execution(spark, folder):
    return approval.execute(_routed(spark, folder))


@query
def updated_catalog(spark, folder):
    done = execution(spark, folder).filter("executed")
    return snapshots.apply_prices(S.catalog(spark, folder), done).select("sku", "our_price", "stock")


@query
def approval_resolution(spark, folder):
    resolved = approval.resolve_answers(
        S.queued_items(spark, folder), S.human_answers(spark, folder)
    )
    return resolved.select("run_id", "sku", "outcome")


@query
def run_metrics(spark, folder):
    return metrics.run_metrics(S.audit_events(spark, folder))


@query
def run_report(spark, folder):
    """The metrics of all runs, written as a JSON report and read back."""
    path, report = _folder(spark, "report"), run_metrics(spark, folder)
    reference_data.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query
def logged_decisions(spark, folder):
    """A run's recommendations as read back from its log, with their place in the log."""
    path = _folder(spark, "decisions")
    audit_log.append_events(daily_run.decision_events(market_context(spark, folder).withColumn("source", F.lit("llm")), "logged"), path)
    rows = metrics.logged_recommendations(audit_log.read_events(spark, path, "logged"))
    return rows.select(
        "run_id", "batch", "position", F.col("rec.sku").alias("sku"), F.col("rec.recommended_price").alias("recommended_price")
    )


@query
def hallucination_flags(spark, folder):
    rows = metrics.flagged_recommendations(S.audit_events(spark, folder))
    return rows.select("run_id", "position", "sku")


@query
def run_summary(spark, folder):
    run = daily_run.pricing_run(
        S.catalog(spark, folder),
        S.prices(spark, folder),
        S.known_elasticity(spark, folder),
        S.suggestions(spark, folder),
        run_id="daily",
    )
    return run.summary


@query
def market_context(spark, folder):
    rows = recommendations.with_market_context(
        suggestion_recs(spark, folder), S.analysis(spark, folder)
    )
    return rows.select(
        "sku",
        "recommended_price",
        "min_competitor_price",
        "max_competitor_price",
        "avg_competitor_trend_pct",
    )


@query
def audit_summary(spark, folder):
    """Words of each document as they would be logged: a long list shows only its size."""
    docs = S.table(spark, folder, "documents")
    return docs.select(
        "doc_id", X.collection_summary(F.split("text", " "), "items", 20).alias("logged")
    )


# --- reporting ---------------------------------------------------------------------------


@query
def call_costs(spark, folder):
    rows = calls.with_cost(S.call_log(spark, folder), S.IN_RATE, S.OUT_RATE)
    return rows.select("run_id", "seq", F.round("cost_usd", 6).alias("cost_usd"))


@query
def call_stats(spark, folder):
    stats = calls.call_stats(
        S.call_log(spark, folder), S.call_requests(spark, folder), S.IN_RATE, S.OUT_RATE
    )
    models = F.transform(
        F.map_entries("models_used"),
        lambda m: F.concat(m["key"], F.lit("="), m["value"].cast("string")),
    )
    return stats.withColumn("models_used", F.concat_ws(",", models))


@query
def budget_cutoff(spark, folder):
    rows = calls.within_budget(S.call_log(spark, folder), S.IN_RATE, S.OUT_RATE)
    return rows.select("run_id", "seq", F.round("spent_before", 6).alias("spent_before"))


@query
def answered_requests(spark, folder):
    answers = S.call_log(spark, folder).filter("ok").select("run_id", "request_key", "model")
    return calls.answers_for_requests(S.call_requests(spark, folder), answers)


@query
def guarded_follow(spark, folder):
    days = S.market_days(spark, folder).select(
        "sku", "day", F.col("market_c").alias("target_c"), "cost_c", F.col("our_c").alias("start_c")
    )
    return scorecard.guarded_follow(days).select(
        "sku",
        "day",
        F.col("target_c_before").alias("before_c"),
        F.col("target_c_price").alias("price_c"),
    )


@query
def strategy_optimum(spark, folder):
    days = S.market_days(spark, folder)
    best = scorecard.strategy_optimum(F.col("market_c"), F.col("cost_c"), F.col("elasticity"))
    low, high = G.guard_bounds(F.col("cost_c"), F.col("our_c"))
    return days.select("sku", "day", G.clip(best, low, high).alias("price_c"))


@query
def price_moves(spark, folder):
    """Moves of each competitor's price from one of its days to the next."""
    rows = S.prices(spark, folder).select(
        F.col("competitor").alias("strategy"),
        "sku",
        F.col("date").alias("day"),
        "price",
        F.col("price").alias("start_price"),
    )
    moved = scorecard.with_previous_price(rows)
    return moved.select(
        "strategy",
        "sku",
        "day",
        "before_price",
        (F.abs(F.col("price") - F.col("before_price")) > DEFAULT_POLICY.price_moved).alias("moved"),
    )


@query
def strategy_scorecard(spark, folder):
    days = staged(S.market_days(spark, folder), "market-days")
    return scorecard.scorecard(scorecard.strategy_days(days))


# --- streams -----------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder for one stream run."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _stream(spark, folder: str, name: str) -> DataFrame:
    schema = S.table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(
        folder
    )


def _run_to_parquet(stream: DataFrame, spark, name: str) -> DataFrame:
    out = _folder(spark, name)
    q = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}-state")
        .option("path", out)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_success_rate(spark, folder):
    events = _stream(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit("tool").alias("agent"),
        (F.col("event_type") != "error").alias("success"),
    )
    return _run_to_parquet(audit_rate.success_rate(events), spark, "success-rate")


@query
def stream_price_feed(spark, folder):
    """The price feed as a stream into a table; the table's content after the run."""
    parts = S.catalog(spark, folder).select("sku", "our_price")
    items = _stream(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("sku"),
        (F.col("l_suppkey") % 4).cast("string").alias("competitor"),
        (F.lit(8500) + cents(F.col("l_extendedprice")) % 3001).alias("share"),
        (F.col("l_returnflag") != "R").alias("in_stock"),
        F.to_date("l_shipdate").alias("date"),
        # arrival: the ship day plus a time of day that follows the order of arrival
        (
            F.col("l_shipdate").cast("timestamp")
            + F.make_dt_interval(mins=F.lit(0), secs=(F.col("l_orderkey") * 10 + F.col("l_linenumber")) / 1e5)
        ).alias("arrived_at"),
    )
    feed = items.join(parts, "sku").select(
        "sku",
        "competitor",
        (F.floor(cents(F.col("our_price")) * F.col("share") / 10000) / 100.0).alias("price"),
        "in_stock",
        "date",
        "arrived_at",
    )
    table = price_feed.PriceTable(spark, _folder(spark, "prices"))
    q = price_feed.maintain_prices(feed, table, _folder(spark, "prices-state"))
    q.awaitTermination()
    return table.read().select("sku", "competitor", "price", "in_stock", "date")


@query
def stream_approvals_resolved(spark, folder):
    """All items of the queue, earliest answer each.

    Items whose time limit the watermark has not passed at the end of the stream are pending.
    """
    item = (
        F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string")).alias("run_id"),
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("sku"),
    )
    events = _stream(spark, folder, "events").select(
        *item,
        F.col("ts").cast("timestamp").alias("at"),
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    pending = events.select("run_id", "sku", F.col("at").alias("created_at"))
    decisions = events.filter("event_type <> 'view'").select(
        "run_id",
        "sku",
        (F.col("event_type") != "error").alias("approved"),
        (F.col("at") + F.make_dt_interval(secs=F.col("k") * 7)).alias("decided_at"),
    )
    resolved = stream_approvals.resolve_stream(pending, decisions)
    done = _run_to_parquet(resolved, spark, "approvals")
    closed = stream_approvals.first_answers(done).select("run_id", "sku", "outcome")
    queue = S.table(spark, folder, "events").select(*item)
    outcome = F.coalesce("outcome", F.lit("pending")).alias("outcome")
    return queue.join(closed, ["run_id", "sku"], "left").select("run_id", "sku", outcome)


@cache
def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)
