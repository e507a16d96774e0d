"""Session set-up and reuse of intermediate tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", app: str = "pricemill") -> SparkSession:
    """Session for tests and benchmarks on one machine. Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        # small tables still use every core
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster; a temporary one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pricemill-"))
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several outputs read, once, to the shared folder and read it back.

    The copy outlives lost executors, keeps later plans short, and gives them file statistics to
    choose join strategies by. The folder stays until `discard` or the cluster's own clean-up of that place.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/pricemill/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._staged_path = path
    return written


def discard(*frames: DataFrame) -> None:
    """Delete the folders of `staged` frames that nobody reads any more, and what shuffles left behind them.

    Spark frees shuffle files once the driver has collected the frames that made them, so it is asked to collect.
    """
    gc.collect()
    for frame in frames:
        spark = frame.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(frame._staged_path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def default_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))
