"""Demand elasticity from sales history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill import schemas
from pricemill.functions.demand import market_gap
from pricemill.functions.money import cents
from pricemill.operators.market import daily_market
from pricemill.operators.medians import exact_median
from pricemill.params import DEFAULT_POLICY, Policy


def sales_observations(sold: DataFrame, prices: DataFrame) -> DataFrame:
    """Sales rows (sku, category, date, price, units, stock) placed against the day's market.

    `gap` is relative to the market price. A day that sold all the stock is marked as capped.
    """
    market = daily_market(prices)
    return sold.join(market, ["sku", "date"]).select(
        "sku",
        "category",
        market_gap(cents(F.col("price")).cast("double"), F.col("market_cents")).alias("gap"),
        F.col("units").cast("double").alias("units"),
        (F.col("units") >= F.col("stock")).alias("capped"),
    )


SUMS = ("n", "sum_x", "sum_y", "sum_xx", "sum_xy")


def sales_sums(sales: DataFrame) -> DataFrame:
    """What a regression of units on gap needs of some sales, per SKU: count, sums and products.

    Capped days are left out: they report the stock, not the demand. Sums of parts add up to the sums of the whole, so
    a new day is summed alone and merged. Gaps lie around zero, so the products lose no digits.
    """
    schemas.require(sales, schemas.SALES, "sales", optional=("capped",))
    if "capped" in sales.columns:
        sales = sales.filter(~F.coalesce("capped", F.lit(False)))
    x, y = F.col("gap"), F.col("units")
    # as in the built-in regression, rows without one of both count for nothing
    both = sales.filter(x.isNotNull() & y.isNotNull())
    return both.groupBy("sku", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sum_x"),
        F.sum(y).alias("sum_y"),
        F.sum(x * x).alias("sum_xx"),
        F.sum(x * y).alias("sum_xy"),
    )


def merged_sums(parts: DataFrame) -> DataFrame:
    """Sums of several parts, one row per SKU."""
    return parts.groupBy("sku", "category").agg(*(F.sum(c).alias(c) for c in SUMS))


def append_sales(sales: DataFrame, path: str, batch: str) -> None:
    """Add a batch of sales to the stored sums. The same batch again replaces itself and counts once."""
    sums = sales_sums(sales).withColumn("batch", F.lit(batch))
    sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def stored_sums(spark: SparkSession, path: str) -> DataFrame:
    """Sums over all batches: reads one row per SKU and batch, no sales."""
    return merged_sums(spark.read.parquet(path))


def fits_from_sums(sums: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The fits of `sku_fits` from `merged_sums`."""
    n = F.col("n").cast("double")
    xx = F.col("sum_xx") - F.col("sum_x") * F.col("sum_x") / n
    xy = F.col("sum_xy") - F.col("sum_x") * F.col("sum_y") / n
    slope = F.when(xx > 0, xy / xx)
    fits = sums.select(
        "sku",
        "category",
        slope.alias("slope"),
        ((F.col("sum_y") - slope * F.col("sum_x")) / n).alias("intercept"),
        F.sqrt(F.greatest(xx, F.lit(0.0)) / F.nullif(n - 1, F.lit(0.0))).alias("gap_std"),
        (F.col("sum_y") / n).alias("mean_units"),
        F.col("n").alias("observations"),
    )
    return _usable_fits(fits, policy)


def _usable_fits(fits: DataFrame, policy: Policy) -> DataFrame:
    return fits.filter(
        (F.col("observations") >= policy.min_observations)
        & (F.col("gap_std") >= policy.min_gap_std)
        & (F.col("mean_units") >= policy.min_mean_units)
        & (F.col("intercept") > 0)
    ).withColumn("elasticity", F.col("slope") / F.col("intercept"))


def sku_fits(sales: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Least-squares fit of units on gap per SKU, and the elasticity at the market price.

    Capped days are left out: they report the stock, not the demand. The regression sums are
    built before the shuffle, so a SKU with very many rows costs one row per map task.
    """
    schemas.require(sales, schemas.SALES, "sales", optional=("capped",))
    if "capped" in sales.columns:
        sales = sales.filter(~F.coalesce("capped", F.lit(False)))
    fits = sales.groupBy("sku", "category").agg(
        F.regr_slope("units", "gap").alias("slope"),
        F.regr_intercept("units", "gap").alias("intercept"),
        F.stddev_samp("gap").alias("gap_std"),
        F.avg("units").alias("mean_units"),
        F.count(F.lit(1)).alias("observations"),
    )
    return _usable_fits(fits, policy)


def estimate_elasticity(sales: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Median elasticity over the SKUs of each category, 3 digits."""
    fits = sku_fits(sales, policy)
    return exact_median(fits, "category", "elasticity").select(
        "category", F.round("median", 3).alias("elasticity")
    )


def estimation_error(estimates: DataFrame, known: DataFrame) -> DataFrame:
    """Per category: estimate against the known value."""
    k = known.select("category", F.col("elasticity").alias("known"))
    return estimates.join(k, "category").select(
        "category",
        F.col("known"),
        F.col("elasticity").alias("estimated"),
        F.round(F.abs(F.col("known") - F.col("elasticity")), 3).alias("abs_error"),
    )


def mean_abs_error(estimates: DataFrame, known: DataFrame) -> DataFrame:
    k = known.select("category", F.col("elasticity").alias("known"))
    gap = F.abs(F.col("known") - F.col("elasticity"))
    return estimates.join(k, "category").agg(F.round(F.avg(gap), 3).alias("mean_abs_error"))
