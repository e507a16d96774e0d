"""Exact order statistics per group without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.session import staged


# Buckets per power of two, and parts of the bucket that holds a middle value.
PER_OCTAVE, PARTS = 1 << 10, 1 << 21
# Above the place of every finite value in either direction.
BEYOND = 1100 * PER_OCTAVE


def _place(v: Column) -> tuple[Column, Column]:
    """(bucket, part) of a value, ascending with it: its sign, exponent and first mantissa bits, then the next bits."""
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    mantissa = size / F.pow(F.lit(2.0), exponent) * PER_OCTAVE
    # where log2 rounds to the next power, the bucket is still the same
    bucket = exponent * PER_OCTAVE + F.floor(mantissa) - PER_OCTAVE + BEYOND
    part = F.floor((mantissa - F.floor(mantissa)) * PARTS)
    sign = F.signum(v).cast("long")
    finite = size < F.lit(float("inf"))
    edge = F.when(F.isnan(v), 2 * BEYOND + 1).otherwise(sign * 2 * BEYOND)
    return (
        F.when(v == 0, F.lit(0)).when(finite, sign * bucket).otherwise(edge).cast("long"),
        F.when((v != 0) & finite, sign * part).otherwise(F.lit(0)).cast("long"),
    )


def _middle(counts: DataFrame, keys: list[str], at: str, ranks: tuple[Column, Column] | None = None) -> DataFrame:
    """Of `counts` (keys, at, _n) the rows that hold a middle rank, with `_lo`, `_hi` counted from their start."""
    ordered = Window.partitionBy(*keys).orderBy(at)
    before = F.sum("_n").over(ordered) - F.col("_n")
    if ranks is None:
        total = F.sum("_n").over(Window.partitionBy(*keys))
        ranks = F.call_function("div", total - 1, F.lit(2)), F.call_function("div", total, F.lit(2))
    placed = counts.select(*keys, at, "_n", (ranks[0] - before).alias("_lo"), (ranks[1] - before).alias("_hi"))

    def holds(rank: str):
        return (F.col(rank) >= 0) & (F.col(rank) < F.col("_n"))

    return placed.filter(holds("_lo") | holds("_hi")).drop("_n")


def exact_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Median of `value` per `group`, interpolated between the two middle values.

    A radix selection: values fall into buckets by sign, exponent and ten bits of the mantissa, so their number is
    bounded whatever the values are. Bucket counts (pre-aggregated before the shuffle) locate the middle ranks. Of the
    buckets that hold them the distinct values are written, counted by their next 21 bits, and only
    the parts that hold a middle rank are put in order. Nulls do not count; a group of nulls gives no row; NaN is above all.
    """
    bucket, part = _place(F.col("_v"))
    values = rows.select(group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    bucketed = values.withColumn("_b", bucket)
    counts = bucketed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    middle = _middle(counts, [group], "_b")
    held = (
        bucketed.join(middle, [group, "_b"])
        .groupBy(group, "_b", "_v", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    held = staged(held.withColumn("_p", part), "median-values")
    places = [group, "_b"]
    in_part = held.groupBy(*places, "_p").agg(
        F.sum("_k").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")
    )
    inner = _middle(in_part, places, "_p", (F.col("_lo"), F.col("_hi")))
    inside = Window.partitionBy(*places, "_p").orderBy("_v")
    ends = (
        held.drop("_lo", "_hi").join(inner, [*places, "_p"])
        .withColumn("_end", F.sum("_k").over(inside))
    )
    start = F.col("_end") - F.col("_k")

    def at(rank: str):
        hit = (F.col(rank) >= start) & (F.col(rank) < F.col("_end"))
        return F.max(F.when(hit, F.col("_v")))

    return ends.groupBy(group).agg(((at("_lo") + at("_hi")) / F.lit(2.0)).alias("median"))


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Element n//2 of the sorted whole-number values per group, from their histogram."""
    histogram = (
        rows.filter(F.col(value).isNotNull())
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    running = F.sum("_n").over(Window.partitionBy(group).orderBy(value))
    total = F.sum("_n").over(Window.partitionBy(group))
    return (
        histogram.select(
            group, value, running.alias("_end"), F.call_function("div", total, F.lit(2)).alias("_k")
        )
        .filter(F.col("_end") > F.col("_k"))
        .groupBy(group)
        .agg(F.min(value).alias("upper_median"))
    )
