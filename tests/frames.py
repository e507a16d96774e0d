"""Small literal tables."""

import datetime as dt

from pricemill import schemas

DAY = dt.date(2026, 8, 15)


def catalog(spark, *items):
    """items: (sku, price, cost, stock[, category[, name]])"""
    full = []
    for sku, price, cost, stock, *more in items:
        category = more[0] if more else "c"
        name = more[1] if len(more) > 1 else f"Brand {sku}"
        full.append((sku, name, name.split()[0], category, float(price), float(cost), stock))
    return spark.createDataFrame(full, schemas.CATALOG)


def prices(spark, *points):
    """points: (sku, competitor, price, in_stock, days before DAY)"""
    full = [
        (sku, comp, float(price), ok, DAY - dt.timedelta(days=back))
        for sku, comp, price, ok, back in points
    ]
    return spark.createDataFrame(full, schemas.PRICES)


def problems(spark, *items, **columns):
    """items: dicts with sku, cost, price, stock, e and optional ref and category"""
    from pricemill.operators.candidates import pricing_problems

    full = [
        (
            i["sku"],
            i.get("category", "c"),
            float(i["cost"]),
            float(i["price"]),
            i.get("stock", 100),
            float(i["e"]),
            i.get("ref"),
        )
        for i in items
    ]
    schema = (
        "sku string, category string, cost double, current_price double, stock int, "
        "elasticity double, reference_price double"
    )
    return pricing_problems(spark.createDataFrame(full, schema))


def budgets(spark, **cents):
    return spark.createDataFrame(
        [(c, float(b)) for c, b in cents.items()], "category string, budget double"
    )
