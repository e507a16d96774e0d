"""Strategies side by side: guarded following, strategy optimum and the scorecard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill import schemas
from pricemill.functions import demand as D
from pricemill.functions import guardrails as G
from pricemill.functions.money import cents, from_cents
from pricemill.params import DEFAULT_POLICY, Policy


def strategy_optimum(market_c: Column, cost_c: Column, elasticity: Column) -> Column:
    """Profit optimum under linear demand, in whole cents, before the guardrails."""
    return F.round(D.unconstrained_optimum(market_c, cost_c, elasticity)).cast("long")


def guarded_follow(
    days: DataFrame, targets: Sequence[str] = ("target_c",), policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Follow target prices day by day within the guardrails, each target on its own path.

    days: sku, day, cost_c, start_c and the target columns, in cents. Adds `<target>_before` and
    `<target>_price` to sku, day and the targets. Today's limits start from yesterday's clipped
    price, which no window frame can express, so each SKU's days are folded in order. A group is
    one row per calendar day of one SKU, hence bounded by the calendar and not by the data.
    """

    def next_day(acc: Column, d: Column) -> Column:
        state, step = [], [d["day"].alias("day")]
        for t in targets:
            low, high = G.guard_bounds(acc["cost_c"], acc[t], policy)
            price = G.clip(d[t], low, high)
            state.append(price.alias(t))
            step += [d[t].alias(t), acc[t].alias(f"{t}_before"), price.alias(f"{t}_price")]
        path = F.concat(acc["path"], F.array(F.struct(*step)))
        return F.struct(*state, acc["cost_c"].alias("cost_c"), path.alias("path"))

    day_type = days.schema["day"].dataType.simpleString()
    step_type = ",".join(f"{t}:bigint,{t}_before:bigint,{t}_price:bigint" for t in targets)
    start = F.struct(
        *[F.col("start_c").alias(t) for t in targets],
        F.col("cost_c"),
        F.array().cast(f"array<struct<day:{day_type},{step_type}>>").alias("path"),
    )
    per_sku = days.groupBy("sku").agg(
        F.array_sort(F.collect_list(F.struct("day", *targets))).alias("days"),
        F.first("cost_c").alias("cost_c"),
        F.first("start_c").alias("start_c"),
    )
    return per_sku.select(
        "sku", F.inline_outer(F.aggregate("days", start, next_day, lambda acc: acc["path"]))
    )


def with_previous_price(rows: DataFrame) -> DataFrame:
    """Adds the strategy's previous price of the SKU; the start price on its first day."""
    order = Window.partitionBy("strategy", "sku").orderBy("day")
    return rows.withColumn(
        "before_price", F.coalesce(F.lag("price").over(order), F.col("start_price"))
    )


def strategy_totals(rows: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Revenue, profit, units, guardrail violations and price changes per strategy."""
    schemas.require(rows, schemas.STRATEGY_DAYS, "strategy days")
    before, after = cents(F.col("before_price")), cents(F.col("price"))
    cost = cents(F.col("cost"))
    broken = G.breaks_limits(cost, before, after, policy)
    moved = F.abs(F.col("price") - F.col("before_price")) > policy.price_moved
    return (
        with_previous_price(rows)
        .groupBy("strategy")
        .agg(
            F.sum(F.col("price") * F.col("units")).alias("revenue"),
            F.sum((F.col("price") - F.col("cost")) * F.col("units")).alias("profit"),
            F.sum("units").alias("units"),
            F.count_if(broken).alias("guardrail_violations"),
            F.count_if(moved).alias("price_changes"),
        )
    )


def scorecard(
    rows: DataFrame,
    baseline: str = "static",
    bound: str = "optimum",
    policy: Policy = DEFAULT_POLICY,
) -> DataFrame:
    """Each strategy against the baseline and the upper bound, one row per strategy.

    The comparison runs over the totals, which have one row per strategy.
    """
    every = Window.partitionBy(F.lit(0))

    def profit_of(name: str) -> Column:
        return F.max(F.when(F.col("strategy") == name, F.col("profit"))).over(every)

    totals = strategy_totals(rows, policy).withColumns(
        {"_base": profit_of(baseline), "_bound": profit_of(bound)}
    )
    uplift = F.col("profit") - F.col("_base")
    return totals.select(
        "strategy",
        F.round("profit").alias("gross_profit"),
        F.round("revenue").alias("revenue"),
        F.round(100 * F.try_divide(uplift, F.col("_base")), 2).alias("profit_vs_baseline_pct"),
        F.round(100 * F.try_divide(uplift, F.col("_bound") - F.col("_base")), 1).alias(
            "share_of_bound_uplift_pct"
        ),
        F.round(100 * F.try_divide(F.col("profit"), F.col("revenue")), 2).alias("avg_margin_pct"),
        "guardrail_violations",
        "price_changes",
    )


def strategy_days(markets: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Prices and units of the built-in strategies on recorded market days.

    markets: sku, day, market_c, our_c, cost_c, stock, elasticity, base_demand. Strategies:
    static, match (the market price as it is), match_guarded, optimum. Both guarded paths come
    from one fold.
    """
    facts = ["our_c", "cost_c", "stock", "elasticity", "base_demand"]
    best = strategy_optimum(F.col("market_c"), F.col("cost_c"), F.col("elasticity"))
    paths = guarded_follow(
        markets.select(
            "sku", "day", "market_c", best.alias("best_c"), "cost_c", F.col("our_c").alias("start_c")
        ),
        ("market_c", "best_c"),
        policy,
    )
    products = markets.groupBy("sku").agg(*[F.first(c).alias(c) for c in facts])

    def priced(name: str, price: str) -> Column:
        return F.struct(F.lit(name).alias("strategy"), F.col(price).alias("price_c"))

    strategies = F.array(
        priced("static", "our_c"),
        priced("match", "market_c"),
        priced("match_guarded", "market_c_price"),
        priced("optimum", "best_c_price"),
    )
    rows = paths.join(products, "sku").select(
        "sku", "day", "market_c", *facts, F.inline_outer(strategies)
    )
    wanted = D.linear_demand(
        F.col("price_c"), F.col("market_c"), F.col("elasticity"), F.col("base_demand")
    )
    return rows.select(
        "strategy",
        "sku",
        "day",
        from_cents(F.col("price_c")).alias("price"),
        from_cents(F.col("our_c")).alias("start_price"),
        from_cents(F.col("cost_c")).alias("cost"),
        D.capped_units(wanted, F.col("stock")).alias("units"),
    )
