"""Price limits as column expressions. All prices and costs are whole cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricemill.functions.money import BP, ceil_div, exact_ratio, whole_div
from pricemill.params import DEFAULT_POLICY, Policy


def margin(price: Column, cost: Column) -> Column:
    return (price - cost) / price


def projected_margin(price: Column, cost: Column) -> Column:
    return exact_ratio(price - cost, price, 4)


def keeps_margin(price: Column, cost: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return (price - cost) * BP >= price * policy.min_margin_bp


def within_max_change(current: Column, price: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return F.abs(price - current) * BP <= current * policy.max_change_bp


def stock_allows(
    current: Column, price: Column, stock: Column, policy: Policy = DEFAULT_POLICY
) -> Column:
    """Cuts always pass; raises need more than the low-stock level."""
    return (price <= current) | (stock > policy.low_stock_units)


def first_violation(
    current: Column, price: Column, cost: Column, stock: Column, policy: Policy = DEFAULT_POLICY
) -> Column:
    return (
        F.when(~keeps_margin(price, cost, policy), "below_min_margin")
        .when(~within_max_change(current, price, policy), "exceeds_max_price_change")
        .when(~stock_allows(current, price, stock, policy), "low_stock_blocks_raise")
        .otherwise("none")
    )


def margin_floor_price(cost: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """Lowest whole-cent price that keeps the margin."""
    return ceil_div(cost * BP, BP - policy.min_margin_bp)


def change_limits(current: Column, policy: Policy = DEFAULT_POLICY) -> tuple[Column, Column]:
    down = ceil_div(current * (BP - policy.max_change_bp), BP)
    up = whole_div(current * (BP + policy.max_change_bp), BP)
    return down, up


def guard_bounds(
    cost: Column, current: Column, policy: Policy = DEFAULT_POLICY
) -> tuple[Column, Column]:
    """Lowest and highest allowed price; the margin floor wins over the change limit."""
    down, up = change_limits(current, policy)
    low = F.greatest(down, margin_floor_price(cost, policy))
    return low, F.greatest(low, up)


def clip(price: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, price))


def breaks_limits(
    cost: Column, before: Column, after: Column, policy: Policy = DEFAULT_POLICY
) -> Column:
    """Violation count of the scorecard: margin or change, stock not considered."""
    return ~keeps_margin(after, cost, policy) | ~within_max_change(before, after, policy)


def is_reversible(current: Column, price: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """Raises above half the allowed change are treated as hard to take back."""
    return ~((price > current) & ((price - current) * BP * 2 > current * policy.max_change_bp))


def optimizer_confidence(
    current: Column, price: Column, policy: Policy = DEFAULT_POLICY
) -> Column:
    small = F.abs(price - current) * BP <= current * policy.small_change_bp
    return F.when(small, F.lit(policy.small_change_confidence)).otherwise(
        F.lit(policy.large_change_confidence)
    )
