"""Linear demand around a reference price. Prices are whole cents, results doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricemill.functions.money import as_column


def value_or(value: Column, default: Column) -> Column:
    """`value`, or `default` where it is null or zero."""
    return F.coalesce(F.nullif(value, F.lit(0)), default)


def linear_demand(price: Column, reference: Column, elasticity: Column, base=1.0) -> Column:
    shift = (price.cast("double") - reference.cast("double")) / reference.cast("double")
    return as_column(base) * F.greatest(F.lit(0.0), F.lit(1.0) + elasticity * shift)


def capped_units(demand: Column, stock: Column) -> Column:
    return F.least(demand, stock.cast("double"))


def candidate_value(price: Column, cost: Column, units: Column, objective: str) -> Column:
    """Objective of one candidate price, in cents."""
    if objective == "profit":
        return (price - cost).cast("double") * units
    if objective == "revenue":
        return price.cast("double") * units
    raise ValueError(f"objective must be profit or revenue, not {objective}")


def discount_spend(current: Column, price: Column, units: Column) -> Column:
    return F.greatest(F.lit(0), current - price).cast("double") * units


def unconstrained_optimum(market: Column, cost: Column, elasticity: Column) -> Column:
    """Profit-maximal price under linear demand, before any clipping, in cents as a double."""
    pull = market.cast("double") * (elasticity - F.lit(1.0)) / (F.lit(2.0) * elasticity)
    return pull + cost.cast("double") / F.lit(2.0)


def market_gap(price: Column, market: Column) -> Column:
    """Distance from the market, relative to the market price."""
    return (price - market) / market


def call_cost(tokens_in: Column, tokens_out: Column, in_rate: float, out_rate: float) -> Column:
    """Cost of one call from rates per million tokens."""
    million = F.lit(1_000_000.0)
    return tokens_in / million * F.lit(in_rate) + tokens_out / million * F.lit(out_rate)
