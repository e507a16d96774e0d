import itertools
import random
from dataclasses import replace

import pytest
from frames import budgets, problems

from pricemill.operators.candidates import optimum_prices, price_candidates, with_bounds
from pricemill.operators.optimizer import optimize_prices
from pricemill.params import Policy

REVENUE = Policy(min_margin_bp=2000, max_change_bp=5000, low_stock_units=-1, objective="revenue", grid_points=11)


def test_margin_and_change_bounds_hold(spark):
    policy = Policy(objective="revenue", grid_points=11, low_stock_units=-1)
    p = problems(
        spark,
        {"sku": "A", "cost": 100, "price": 150, "e": -1.2, "stock": 50},
        {"sku": "B", "cost": 200, "price": 250, "e": -0.8, "stock": 50},
    )
    for r in price_candidates(p, policy).join(p, "sku").collect():
        assert (r.price_c - r.cost_c) * 100 >= 15 * r.price_c
        assert abs(r.price_c - r.current_c) * 4 <= r.current_c
    chosen = optimize_prices(p, budgets(spark, c=100_000), policy).prices
    assert chosen.count() == 2


def test_margin_floor_wins_over_change_limit(spark):
    policy = Policy(min_margin_bp=1000, max_change_bp=200, low_stock_units=-1)
    p = problems(spark, {"sku": "X", "cost": 95, "price": 100, "e": -1.0})
    [r] = optimum_prices(p, policy).collect()
    assert r.price_c == 10556


def test_low_stock_and_exact_change_bound(spark):
    p = problems(
        spark,
        {"sku": "A", "cost": 1307.94, "price": 1665.32, "stock": 105, "e": -0.2, "ref": 2500.0},
        {"sku": "B", "cost": 549.25, "price": 717.19, "stock": 0, "e": -0.2, "ref": 900.0},
        {"sku": "C", "cost": 5, "price": 19.99, "stock": 3, "e": -0.2, "ref": 30.0},
    )
    found = {r.sku: r.price_c for r in optimize_prices(p, budgets(spark, c=1e12)).prices.collect()}
    assert found == {"A": 208165, "B": 71719, "C": 1999}
    high = {r.sku: r.high_c for r in with_bounds(p).collect()}
    assert high["C"] == 1999


def test_market_pull(spark):
    p = problems(spark, {"sku": "A", "cost": 50, "price": 120, "stock": 1000, "e": -3.0, "ref": 100.0})
    [r] = optimum_prices(p).collect()
    assert r.price_c < 12000


def test_tight_budget_keeps_the_price_up(spark):
    p = problems(spark, {"sku": "R", "cost": 40, "price": 100, "e": -2.0})
    wide = optimize_prices(p, budgets(spark, c=100_000), REVENUE).prices.first()
    tight = optimize_prices(p, budgets(spark, c=100), REVENUE).prices.first()
    assert tight.price_c > wide.price_c and tight.spend <= 100


def test_impossible_budget_is_reported(spark, rows):
    p = problems(spark, {"sku": "R", "cost": 40, "price": 100, "e": -2.0})
    joint = optimize_prices(p, budgets(spark, c=-1), REVENUE)
    assert joint.prices.count() == 0
    assert rows(joint.rejected, "sku", "reason") == [("R", "budget_infeasible")]


def test_zero_stock_keeps_the_current_price(spark):
    p = problems(spark, {"sku": "Z", "cost": 40, "price": 100, "e": -2.0, "stock": 0})
    assert optimum_prices(p).first().price_c == 10000


def _brute(options, budget):
    best = None
    for pick in itertools.product(*options):
        if sum(o[1] for o in pick) <= budget + 1e-6:
            value = sum(o[0] for o in pick)
            best = value if best is None else max(best, value)
    return best


def test_binding_budgets_against_brute_force(spark):
    """Many small categories at once, each with its own budget: the best combination is within the gap."""
    rng = random.Random(5)
    policy = replace(REVENUE, grid_points=7, min_margin_bp=1000)
    items, limits = [], {}
    for c in range(24):
        limits[f"c{c}"] = rng.choice([5, 500, 1500, 3000, 8000])
        for i in range(rng.randint(1, 5)):
            cost = rng.randint(20, 70)
            items.append(
                {"sku": f"{c}-{i}", "category": f"c{c}", "cost": cost, "price": cost + rng.randint(15, 60),
                 "e": -rng.choice([1.5, 2.0, 2.7, 3.3]), "stock": rng.choice([1, 2, 50]),
                 "ref": float(cost + rng.randint(5, 60))}
            )
    p = problems(spark, *items)
    by_category = {}
    for r in price_candidates(p, policy).collect():
        by_category.setdefault(r.category, {}).setdefault(r.sku, []).append((r.value, r.spend))
    joint = optimize_prices(p, budgets(spark, **limits), policy)
    states, reached = [], []
    for r in joint.categories.collect():
        best = _brute(list(by_category[r.category].values()), limits[r.category])
        assert r.spend <= limits[r.category] + 1e-6
        assert r.value <= best + 1e-4 and best <= r.value + r.gap + 1e-4, r
        states.append(r.state)
        reached.append(r.value / best)
    assert states.count("binding") > 8
    assert sum(reached) / len(reached) > 0.99 and sum(x > 1 - 1e-9 for x in reached) > len(reached) / 2
    assert joint.prices.count() == len(items)


def test_one_hot_category_of_equal_products(spark):
    """A third of all products alike: their steps have one ratio, the budget cuts through them."""
    same = [{"sku": f"s{i}", "category": "hot", "cost": 40, "price": 100, "e": -2.0} for i in range(60)]
    p = problems(spark, *same)
    joint = optimize_prices(p, budgets(spark, hot=20_000), REVENUE)
    r = joint.categories.first()
    one = sorted((c.value, c.spend) for c in price_candidates(problems(spark, same[0]), REVENUE).collect())
    assert r.skus == 60 and r.spend <= 20_000 + 1e-6
    # at most one step short of the relaxation's bound
    assert r.gap <= max(v for v, _ in one)
    assert r.value > 60 * 10_000


def _by_the_rule(options, budget):
    """The budget rule in plain loops: hull steps in order, then rounds of single moves. options: {sku: [(spend, value)]}."""
    at = {k: min(o, key=lambda c: (c[0], -c[1])) for k, o in options.items()}
    steps = []
    for k, o in options.items():
        here, ratio, n = at[k], float("inf"), 0
        while ahead := [c for c in o if c[0] > here[0] and c[1] > here[1]]:
            slope, c = max(((c[1] - here[1]) / (c[0] - here[0]), c) for c in ahead)
            ratio = min(ratio, slope)
            steps.append((-ratio, k, n, c[0] - here[0], c))
            here, n = c, n + 1
    rest = budget - sum(c[0] for c in at.values())
    for _, k, _, cost, c in sorted(steps):
        if cost > rest + 1e-6:
            break
        rest, at[k] = rest - cost, c
    while True:
        moves = []
        for k, o in options.items():
            fits = [c for c in o if c[1] - at[k][1] > 1e-6 and -1e-6 <= c[0] - at[k][0] <= rest + 1e-6]
            if fits:
                cost = lambda c: c[0] - at[k][0]  # noqa: B023, E731
                ratio, less, c = max(((c[1] - at[k][1]) / max(cost(c), 1e-6), -cost(c), c) for c in fits)
                moves.append((-ratio, k, -less, c))
        if not moves:
            return sum(c[1] for c in at.values()), sum(c[0] for c in at.values())
        for _, k, cost, c in sorted(moves):
            if cost > rest + 1e-6:
                break
            rest, at[k] = rest - cost, c


def test_one_dear_product_among_many(spark):
    """The dear product's step never fits; what it leaves goes to the 2,000 others of its category."""
    rng = random.Random(8)
    items = [{"sku": "dear", "category": "c", "cost": 250_000, "price": 500_000, "e": -3.0, "stock": 50}]
    items += [
        {"sku": f"s{i:04d}", "category": "c", "cost": 40, "price": 80 + rng.randint(0, 4000) / 100, "e": -2.5, "stock": 99}
        for i in range(2000)
    ]
    policy = Policy(low_stock_units=-1, objective="revenue")
    p = problems(spark, *items)
    options = {}
    for r in price_candidates(p, policy).collect():
        options.setdefault(r.sku, []).append((r.spend, r.value))
    joint = optimize_prices(p, budgets(spark, c=2_000_000), policy)
    r = joint.categories.first()
    value, spend = _by_the_rule(options, 2_000_000)
    assert r.state == "binding" and r.skus == 2001 and r.spend <= 2_000_000 + 1e-6
    assert r.value == pytest.approx(value, rel=1e-12) and r.spend == pytest.approx(spend, rel=1e-9)
    assert 2_000_000 - r.spend < 500
