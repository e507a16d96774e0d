"""Exact money arithmetic: prices as whole cents, ratios rounded without binary error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BP = 10_000


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def whole_div(a: Column, b) -> Column:
    """Integer quotient, rounded towards zero."""
    return F.call_function("div", a, as_column(b))


def ceil_div(a: Column, b: int) -> Column:
    """Integer quotient rounded up, for a >= 0."""
    return whole_div(a + F.lit(b - 1), b)


def cents(price: Column) -> Column:
    """Nearest whole cent. floor(x + 0.5) stays in generated code; round() on doubles does not."""
    return F.floor(price * F.lit(100.0) + F.lit(0.5))


def from_cents(value: Column) -> Column:
    return value.cast("double") / F.lit(100.0)


def half_up(num: Column, den: Column) -> Column:
    """num/den to the nearest whole number, halves away from zero; den > 0."""
    size = whole_div(F.lit(2) * F.abs(num) + den, F.lit(2) * den)
    return F.when(num < 0, -size).otherwise(size)


def exact_ratio(num: Column, den: Column, digits: int) -> Column:
    """num/den rounded to `digits` decimals; null when den is 0."""
    scale = 10**digits
    safe = F.nullif(den, F.lit(0))
    return half_up(num * F.lit(scale), safe).cast("double") / F.lit(float(scale))


def percent_text(tenths: Column) -> Column:
    """123 tenths of a percent -> '12.3%'."""
    return F.concat(
        whole_div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")
    )
