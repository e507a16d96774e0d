"""Append-only audit log as a JSON dataset, one folder per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill import schemas


def as_events(
    rows: DataFrame, run_id: str, agent: str, event: str, *columns: str, summarize_over: int = 0
) -> DataFrame:
    """One audit event per row, with the given columns as its JSON payload.

    With `summarize_over`, longer arrays and maps are replaced by their size.
    """
    from pricemill.functions.text import collection_summary

    fields = []
    for name in columns or rows.columns:
        kind = rows.schema[name].dataType
        if summarize_over and isinstance(kind, (T.ArrayType, T.MapType)):
            label = "items" if isinstance(kind, T.ArrayType) else "entries"
            fields.append(collection_summary(F.col(name), label, summarize_over).alias(name))
        else:
            fields.append(F.col(name))
    return rows.select(
        F.current_timestamp().alias("timestamp"),
        F.lit(run_id).alias("run_id"),
        F.lit(agent).alias("agent"),
        F.lit(event).alias("event"),
        F.to_json(F.struct(*fields)).alias("data"),
        F.lit(None).cast("double").alias("latency_ms"),
    )


def append_events(events: DataFrame, path: str) -> None:
    """`data` may be a JSON text or a struct; both are stored as a JSON text field."""
    if not isinstance(events.schema["data"].dataType, T.StringType):
        events = events.withColumn("data", F.to_json("data"))
    events.write.mode("append").partitionBy("run_id").json(path)


def read_log(
    spark: SparkSession, path: str, run_id: str | None = None, payload: T.StructType | None = None
) -> DataFrame:
    """Events of one run (only its folder is read) or of all runs, payload parsed, and `damaged`.

    `damaged` is null for a sound event. For a line that is no JSON it is the line, and all else but the run is
    null; for a payload that does not decode it is the payload.
    """
    payload = payload or schemas.LOGGED_DATA
    line = T.StructField("_line", T.StringType())
    stored = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name == "data" else f.dataType)
            for f in schemas.EVENTS.fields
        ]
        + [line]
    )
    events = spark.read.schema(stored).option("columnNameOfCorruptRecord", line.name).json(path)
    if run_id is not None:
        events = events.filter(F.col("run_id") == run_id)
    decoded = F.from_json(
        "data", T.StructType([*payload.fields, line]), {"columnNameOfCorruptRecord": line.name}
    )
    parsed = events.withColumn("_data", decoded)
    return parsed.select(
        *[c for c in events.columns if c not in ("data", line.name)],
        F.when(F.col("_data").isNotNull(), F.struct(*[F.col("_data")[f.name].alias(f.name) for f in payload.fields])).alias("data"),
        F.coalesce(line.name, F.col("_data")[line.name]).alias("damaged"),
    )


def read_events(
    spark: SparkSession, path: str, run_id: str | None = None, payload: T.StructType | None = None
) -> DataFrame:
    """The sound events of `read_log`."""
    events = read_log(spark, path, run_id, payload).filter("damaged is null")
    return events.select(*[f.name for f in schemas.EVENTS.fields])
