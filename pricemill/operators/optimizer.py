"""Joint pricing per category: one price per product, most value, discount spend in budget.

Where the best price of every product fits the budget together, that is the optimum. Elsewhere, by one rule for
categories of any size:

1. Candidates that another one of the same product beats in spend and value are dropped, and
   the rest reduced to the steps of their upper hull in (spend, value). Steps are taken by value per spend up to the
   first that does not fit. This solves the linear relaxation but for that step.
2. What is left of the budget goes to moves that still fit: every product offers its steepest one, to any
   candidate of more value within the rest, and these are taken by value per spend up to the first that does not
   fit. This is repeated, with the rest that then remains, until no product has a move that fits.
3. `gap` is the value of the relaxation less the value reached: no choice within the budget is better by more.

The order within a category comes from ranges of (category, ratio): sums per range, offsets from the
sums, and a running sum only inside the range where the budget ends. No task sees a whole category.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.functions.money import BP
from pricemill.operators.candidates import best_candidate, with_candidates
from pricemill.params import DEFAULT_POLICY, Policy
from pricemill.session import staged

# Amounts in cents below this count as equal.
EPS = 1e-6

STEP = "struct<ratio:double,dspend:double,dvalue:double,spend:double,value:double,price_c:bigint>"


class JointPrices(NamedTuple):
    prices: DataFrame  # sku, category, current_c, price_c, value, spend
    categories: DataFrame  # category, skus, budget, state, value, spend, gap
    rejected: DataFrame  # sku, category, current_c, reason
    problems: DataFrame  # the problems as staged for this call


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cheapest(candidates: Column, current: Column) -> Column:
    """Best candidate among those with the least spend: where every product starts."""
    least = F.array_min(F.transform(candidates, lambda c: c["spend"]))
    return _let(
        least,
        lambda low: best_candidate(F.filter(candidates, lambda c: c["spend"] <= low), current),
    )


def _undominated(candidates: Column, current: Column) -> Column:
    """Candidates that no other one beats in spend and value; equal ones by the tie rule."""

    def beats(o: Column, c: Column) -> Column:
        near_o, near_c = F.abs(o["price_c"] - current), F.abs(c["price_c"] - current)
        same = (o["spend"] == c["spend"]) & (o["value"] == c["value"])
        nearer = (near_o < near_c) | ((near_o == near_c) & (o["price_c"] < c["price_c"]))
        better = (o["spend"] <= c["spend"]) & (o["value"] >= c["value"])
        return better & (~same | nearer)

    return F.filter(candidates, lambda c: ~F.exists(candidates, lambda o: beats(o, c)))


def _hull_steps(candidates: Column, start: Column, points: int) -> Column:
    """Steps along the upper hull from `start`, steepest first."""

    def slope(acc: Column, c: Column) -> Column:
        return F.struct(
            ((c["value"] - acc["value"]) / (c["spend"] - acc["spend"])).alias("ratio"),
            c["spend"].alias("spend"),
            c["value"].alias("value"),
            c["price_c"].alias("price_c"),
        )

    def moved(acc: Column, best: Column) -> Column:
        ratio = F.least(best["ratio"], acc["ratio"])
        step = F.struct(
            ratio.alias("ratio"),
            (best["spend"] - acc["spend"]).alias("dspend"),
            (best["value"] - acc["value"]).alias("dvalue"),
            best["spend"].alias("spend"),
            best["value"].alias("value"),
            best["price_c"].alias("price_c"),
        )
        return F.struct(
            best["spend"].alias("spend"),
            best["value"].alias("value"),
            ratio.alias("ratio"),
            F.concat(acc["steps"], F.array(step)).alias("steps"),
        )

    def forward(acc: Column, _: Column) -> Column:
        ahead = F.filter(
            candidates,
            lambda c: (c["spend"] > acc["spend"]) & (c["value"] > acc["value"]),
        )
        steepest = F.array_max(F.transform(ahead, lambda c: slope(acc, c)))
        return _let(
            steepest, lambda best: F.when(best.isNull(), acc).otherwise(moved(acc, best))
        )

    first = F.struct(
        start["spend"].alias("spend"),
        start["value"].alias("value"),
        F.lit(float("inf")).alias("ratio"),
        F.array().cast(f"array<{STEP}>").alias("steps"),
    )
    walk = F.sequence(F.lit(1), F.lit(points - 1))
    return F.aggregate(walk, first, forward, lambda acc: acc["steps"])


def _in_order(steps: DataFrame) -> DataFrame:
    """Steps sorted over ranges of (category, falling ratio, sku, k), written with range and row number.

    One category, or many steps of one ratio, are many ranges.
    """
    order = ["category", F.col("ratio").desc(), "sku", "k"]
    ranged = steps.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(
        ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "steps"
    )


def _taken_steps(placed: DataFrame, room: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps that fit, in order of falling ratio, and per category the ratio of the first that does not.

    placed: category, sku, k, ratio, dspend, ... as `_in_order` returns them; room: category, room (budget left).
    """
    down = Window.partitionBy("category").orderBy("_part")
    ends = placed.groupBy("category", "_part").agg(F.sum("dspend").alias("_s")).withColumn(
        "_end", F.sum("_s").over(down)
    )
    # one row per category and range it lies in, written so that its size is known to the joins below
    ranges = staged(
        ends.join(room.select("category", "room"), "category").select(
            "category",
            "_part",
            (F.col("_end") - F.col("_s")).alias("_start"),
            (F.col("_end") <= F.col("room") + EPS).alias("_whole"),
            "room",
        ),
        "step-ranges",
    )
    near = placed.join(ranges.filter(F.col("_start") <= F.col("room") + EPS), ["category", "_part"])
    inside = Window.partitionBy("category", "_part").orderBy("_row")
    edge = near.filter(~F.col("_whole")).withColumn("_at", F.col("_start") + F.sum("dspend").over(inside))
    fits = F.col("_at") <= F.col("room") + EPS
    columns = [c for c in placed.columns if c not in ("_part", "_row")]
    taken = near.filter("_whole").select(*columns).unionByName(edge.filter(fits).select(*columns))
    first_over = edge.filter(~fits).groupBy("category").agg(F.max("ratio").alias("lam"))
    return taken, first_over


def _moves(rows: DataFrame) -> DataFrame:
    """Each product's steepest move to a candidate of more value within the category's rest.

    rows: category, sku, candidates, price_c, value, spend, rest. Of equally steep moves, the one that costs less.
    """
    gain = lambda c: c["value"] - F.col("value")
    cost = lambda c: c["spend"] - F.col("spend")
    # moves that cost next to nothing count as costing EPS, so that they have a ratio
    options = F.transform(
        F.filter("candidates", lambda c: (gain(c) > EPS) & (cost(c) <= F.col("rest") + EPS) & (cost(c) >= -EPS)),
        lambda c: F.struct(
            (gain(c) / F.greatest(cost(c), F.lit(EPS))).alias("ratio"),
            (-cost(c)).alias("saved"),
            c["price_c"].alias("price_c"),
            c["value"].alias("value"),
            c["spend"].alias("spend"),
        ),
    )
    best = rows.withColumn("_m", F.array_max(options)).filter("_m is not null")
    return best.select(
        "category",
        "sku",
        F.lit(0).alias("k"),
        F.col("_m.ratio").alias("ratio"),
        (-F.col("_m.saved")).alias("dspend"),
        F.col("_m.price_c").alias("price_c"),
        F.col("_m.value").alias("value"),
        F.col("_m.spend").alias("spend"),
    )


def _with_changes(rows: DataFrame, changes: DataFrame, *columns: str) -> DataFrame:
    """`columns` of rows, and the changed choice of the products that have one."""
    choice = ("price_c", "value", "spend")
    renamed = changes.select("category", "sku", *(F.col(c).alias("_" + c) for c in choice))
    joined = rows.join(renamed, ["category", "sku"], "left")
    return joined.select(*columns, *(F.coalesce("_" + c, c).alias(c) for c in choice))


def _spent_rest(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """Last choice of the products that moves have changed: (category, sku, price_c, value, spend).

    rows: category, sku, candidates, price_c, value, spend; rest: category, rest. Every round takes a move
    in each category that has one, and the rest only falls, so a product without a move has none
    later and leaves the rows that are looked at. Rounds end with the moves.
    """
    active, changed = rows, None
    while True:
        offered = active.join(rest, "category")
        moves = _in_order(_moves(offered))
        if moves.isEmpty():
            break
        taken, _ = _taken_steps(moves, rest.withColumnRenamed("rest", "room"))
        taken = staged(taken.select("category", "sku", "dspend", "price_c", "value", "spend"), "taken-moves")
        # a later choice of a product replaces an earlier one
        made = taken.drop("dspend")
        changed = made if changed is None else made.unionByName(changed.join(made, ["category", "sku"], "left_anti"))
        changed = staged(changed, "changed")
        rest = staged(
            rest.join(taken.groupBy("category").agg(F.sum("dspend").alias("_used")), "category").select(
                "category", (F.col("rest") - F.col("_used")).alias("rest")
            ),
            "rest",
        )
        open_rows = active.join(moves.select("category", "sku"), ["category", "sku"], "left_semi")
        active = staged(_with_changes(open_rows, made, "category", "sku", "candidates"), "active")
    return changed


def _with_best(problems: DataFrame, policy: Policy) -> DataFrame:
    return with_candidates(problems, policy).withColumn(
        "_best", best_candidate(F.col("candidates"), F.col("current_c"))
    )


def _limits(problems: DataFrame, budgets: DataFrame | None, policy: Policy) -> DataFrame:
    """Per category: budget, and whether the best prices together fit it."""
    share = F.sum("current_c") * policy.discount_budget_bp / F.lit(float(BP))
    totals = (
        _with_best(problems, policy)
        .withColumn("_start", _cheapest(F.col("candidates"), F.col("current_c")))
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("skus"),
            share.alias("budget"),
            F.sum("_best.spend").alias("free_spend"),
            F.sum("_start.spend").alias("start_spend"),
        )
    )
    if budgets is not None:
        given = budgets.select("category", F.col("budget").cast("double").alias("budget"))
        totals = totals.drop("budget").join(given, "category")
    over = F.col("free_spend") > F.col("budget") + EPS
    impossible = F.col("start_spend") > F.col("budget") + EPS
    return totals.select(
        "category",
        "skus",
        "budget",
        (F.col("budget") - F.col("start_spend")).alias("room"),
        F.when(impossible, "infeasible").when(over, "binding").otherwise("free").alias("state"),
    )


def _within_budget(bound: DataFrame, limits: DataFrame, policy: Policy) -> DataFrame:
    """Prices of the categories whose budget binds. bound: scored rows with their budget."""
    useful = staged(
        bound.select(
            "sku",
            "category",
            "current_c",
            "budget",
            _undominated(F.col("candidates"), F.col("current_c")).alias("candidates"),
        ),
        "useful",
    )
    started = useful.withColumn("_start", _cheapest(F.col("candidates"), F.col("current_c")))
    walked = staged(
        started.withColumn(
            "steps", _hull_steps(F.col("candidates"), F.col("_start"), policy.grid_points)
        ),
        "hull",
    )
    steps = walked.select("category", "sku", F.posexplode("steps").alias("k", "_s")).select(
        "category", "sku", "k", "_s.*"
    )
    taken, cutoff = _taken_steps(_in_order(steps), limits.select("category", "room"))
    reached = taken.groupBy("category", "sku").agg(F.max("k").alias("_k"))
    last = F.get("steps", F.col("_k"))
    stepwise = staged(
        walked.join(reached, ["category", "sku"], "left").select(
            "category",
            "sku",
            "current_c",
            "candidates",
            "budget",
            F.coalesce(last["price_c"], -F.col("_start.low")).alias("price_c"),
            F.coalesce(last["value"], F.col("_start.value")).alias("value"),
            F.coalesce(last["spend"], F.col("_start.spend")).alias("spend"),
        ),
        "stepwise",
    )
    left_over = F.greatest(F.lit(0.0), F.first("budget") - F.sum("spend"))
    state = staged(
        stepwise.groupBy("category")
        .agg(left_over.alias("rest"), F.sum("value").alias("_value"))
        .join(cutoff, "category", "left")
        .select(
            "category",
            "rest",
            (F.col("_value") + F.coalesce("lam", F.lit(0.0)) * F.col("rest")).alias("_bound"),
        ),
        "bounds",
    )
    changed = _spent_rest(
        stepwise.select("category", "sku", "candidates", "price_c", "value", "spend"),
        state.select("category", "rest"),
    )
    chosen = stepwise.select("sku", "category", "current_c", "price_c", "value", "spend")
    if changed is not None:
        chosen = _with_changes(chosen, changed, "sku", "category", "current_c")
    chosen = staged(chosen, "joint")
    short = chosen.groupBy("category").agg(F.sum("value").alias("_reached")).join(state, "category")
    # sums of doubles differ in their last places
    noise = F.lit(EPS) + F.abs("_bound") * 1e-12
    gap = F.col("_bound") - F.col("_reached")
    gaps = staged(short.select("category", F.when(gap > noise, gap).otherwise(0.0).alias("gap")), "gaps")
    return chosen.join(gaps, "category")


def optimize_prices(
    problems: DataFrame, budgets: DataFrame | None = None, policy: Policy = DEFAULT_POLICY
) -> JointPrices:
    """Joint prices per category.

    budgets: category and budget in cents; by default a share of the current prices. Categories
    whose best prices fit the budget need no shuffle beyond one row per category.
    """
    problems = staged(problems, "problems")
    limits = staged(_limits(problems, budgets, policy), "limits")
    rows = _with_best(problems, policy).join(limits, "category")
    chosen = rows.filter("state = 'free'").select(
        "sku",
        "category",
        "current_c",
        (-F.col("_best.low")).alias("price_c"),
        F.col("_best.value").alias("value"),
        F.col("_best.spend").alias("spend"),
        F.lit(0.0).alias("gap"),
    )
    if not limits.filter("state = 'binding'").isEmpty():
        bound = _within_budget(rows.filter("state = 'binding'"), limits, policy)
        chosen = chosen.unionByName(bound)
    categories = (
        chosen.groupBy("category")
        .agg(
            F.sum("value").alias("value"), F.sum("spend").alias("spend"), F.max("gap").alias("gap")
        )
        .join(limits.select("category", "skus", "budget", "state"), "category")
    )
    rejected = (
        problems.join(limits.filter("state = 'infeasible'"), "category")
        .select("sku", "category", "current_c", F.lit("budget_infeasible").alias("reason"))
    )
    return JointPrices(chosen.drop("gap"), categories, rejected, problems)
