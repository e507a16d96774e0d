"""Price points that arrive over time: the last arrival per key wins, whatever order rows come in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricemill.operators.market import competitor_positions
from pricemill.sources.snapshots import PRICE_KEY, last_per_key


def deduplicated(feed: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Stream without rows that repeat an earlier row in all columns, its arrival included.

    feed: price columns and `arrived_at` (timestamp). A value that comes back with a new arrival is a
    correction and stays. Rows that arrive later than `lateness` behind the newest are dropped with
    the state that would recognize them.
    """
    return feed.withWatermark("arrived_at", lateness).dropDuplicatesWithinWatermark(feed.columns)


def latest_points(batch: DataFrame) -> DataFrame:
    """One row per (sku, competitor, date) of a batch: the last to arrive."""
    return last_per_key(batch, PRICE_KEY, ["arrived_at", "price"])


class PriceTable:
    """Price points as Parquet, one folder per batch, merged when read.

    A batch writes only its own rows, and writes the same folder anew when it is run again after
    a failure. Reading keeps the last arrival per key. `compact` folds all batches into one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def apply(self, batch: DataFrame, number: int) -> None:
        folder = f"{self.path.rstrip('/')}/batch={number}"
        latest_points(batch).write.mode("overwrite").parquet(folder)

    def read(self) -> DataFrame:
        return latest_points(self.spark.read.parquet(self.path)).drop("batch")

    def compact(self, target: str, number: int) -> PriceTable:
        """Starts a new table from this one; later batches go on with number + 1."""
        compacted = PriceTable(self.spark, target)
        compacted.apply(self.read(), number)
        return compacted


def maintain_prices(feed: DataFrame, table: PriceTable, checkpoint: str) -> StreamingQuery:
    """Runs the feed into the snapshot table until the available input is used up.

    The table keeps the last arrival per key, so repeats and late rows need no state to be told apart.
    """
    write: Callable[[DataFrame, int], None] = table.apply
    return (
        feed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_positions(points: DataFrame) -> DataFrame:
    """Latest price per (sku, competitor) of a snapshot."""
    return competitor_positions(points).select(
        "sku", "competitor", "latest_date", (F.col("latest_cents") / 100.0).alias("price"), "in_stock"
    )
