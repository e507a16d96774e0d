"""Readers of the engine's own tables. Schemas are declared, nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill import schemas

# Up to this many literal keys travel as an IN list that Parquet can use to skip row groups.
LITERAL_KEYS = 1000


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOG).parquet(path)


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalog as CSV with a header line; columns are taken by name."""
    wide = spark.read.option("header", True).option("enforceSchema", False)
    columns = wide.csv(path).columns
    by_name = {f.name: f.dataType for f in schemas.CATALOG.fields}
    layout = T.StructType([T.StructField(c, by_name.get(c, T.StringType())) for c in columns])
    rows = spark.read.option("header", True).schema(layout).csv(path)
    return rows.select(*[c for c in schemas.CATALOG.fieldNames() if c in columns])


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PRICES).parquet(path)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LISTINGS).parquet(path)


def prices_for_skus(prices: DataFrame, skus: DataFrame | Sequence[str]) -> DataFrame:
    """Every stored price point of the requested SKUs, in one pass.

    A short literal list becomes a pushed-down IN filter; a frame becomes a semi join.
    """
    if isinstance(skus, DataFrame):
        return prices.join(skus.select("sku"), "sku", "left_semi")
    wanted = list(dict.fromkeys(skus))
    if len(wanted) <= LITERAL_KEYS:
        return prices.filter(F.col("sku").isin(wanted)) if wanted else prices.limit(0)
    keys = prices.sparkSession.createDataFrame([(s,) for s in wanted], "sku string")
    return prices.join(keys, "sku", "left_semi")


def prices_for_sku(prices: DataFrame, sku: str) -> DataFrame:
    return prices.filter(F.col("sku") == sku)


def missing_skus(requested: DataFrame, prices: DataFrame) -> DataFrame:
    """Requested SKUs without any price point."""
    return requested.select("sku").distinct().join(prices.select("sku"), "sku", "left_anti")


def research_summary(requested: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: SKUs asked for, SKUs with data, one error per SKU without."""
    found = prices.select("sku").distinct().withColumn("has_prices", F.lit(True))
    return (
        requested.select("sku")
        .join(found, "sku", "left")
        .agg(
            F.count("sku").alias("skus_requested"),
            F.count("has_prices").alias("skus_found"),
            F.count_if(F.col("has_prices").isNull()).alias("errors"),
        )
    )


def distinct_sorted(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)
