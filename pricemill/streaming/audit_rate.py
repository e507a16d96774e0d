"""Success rate of tool events per time window over the audit stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def success_rate(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """events: timestamp, agent, success. Works on a stream (append mode) and on a batch."""
    tool = events.filter(F.col("agent") == "tool")
    if events.isStreaming:
        tool = tool.withWatermark("timestamp", lateness)
    success = F.coalesce("success", F.lit(False)).cast("double")
    return (
        tool.groupBy(F.window("timestamp", width))
        .agg(F.count(F.lit(1)).alias("events"), F.round(F.avg(success), 6).alias("success_rate"))
        .select(F.col("window.start").alias("window_start"), "events", "success_rate")
    )
