"""Keyed snapshots: upserts, column updates and full refreshes.

Plain Parquet has no in-place update, so each change yields the next snapshot of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_KEY = ("sku",)
PRICE_KEY = ("sku", "competitor", "date")


# Types with a fixed width in aggregation buffers: these allow hash aggregation.
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def last_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key by `order`, which must tell the rows of a key apart.

    With one order column and values of fixed width this is a hash aggregate, elsewhere a ranked
    window. Both reduce rows before the shuffle (the window because Spark applies the `<= 1`
    limit there too), so a key with very many versions sends one row per map task.
    """
    values = [c for c in rows.columns if c not in key]
    fixed = all(isinstance(rows.schema[c].dataType, _FIXED) for c in values)
    if len(order) == 1 and fixed and values != list(order):
        last = [F.max_by(c, order[0]).alias(c) for c in values]
        return rows.groupBy(*key).agg(*last).select(*rows.columns)
    newest = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return (
        rows.withColumn("_newest", F.row_number().over(newest))
        .filter(F.col("_newest") <= 1)
        .drop("_newest")
    )


def upsert(
    current: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Next snapshot: incoming rows replace stored rows with the same key.

    Incoming rows are reduced to the last one per key by `order` (any row where no order is
    given and the key is repeated is a caller error; give an order column).
    """
    columns = current.columns
    if order:
        incoming = last_per_key(incoming, key, order)
    fresh = incoming.select(*columns)
    kept = current.join(fresh.select(*key), list(key), "left_anti").select(*columns)
    return kept.unionByName(fresh)


def apply_prices(catalog: DataFrame, executed: DataFrame) -> DataFrame:
    """Catalog with `our_price` replaced by `new_price` for the executed SKUs."""
    changes = executed.select("sku", F.col("new_price").alias("_new_price"))
    return catalog.join(changes, "sku", "left").select(
        *[
            F.coalesce("_new_price", "our_price").alias("our_price") if c == "our_price" else c
            for c in catalog.columns
        ]
    )


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full refresh. Write to a new path when `df` is read from the old snapshot."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
