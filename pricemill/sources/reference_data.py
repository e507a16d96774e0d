"""Small lookup tables, the approval queue and report files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill import schemas
from pricemill.params import DEFAULT_POLICY, Policy
from pricemill.session import staged


def write_elasticity(estimates: DataFrame, path: str) -> None:
    estimates.select("category", "elasticity").write.mode("overwrite").json(path)


def read_elasticity(spark: SparkSession, path: str) -> DataFrame:
    """Stored estimates, or an empty table where none were written yet."""
    try:
        return spark.read.schema(schemas.ELASTICITY).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.ELASTICITY)


def with_elasticity(
    rows: DataFrame, elasticity: DataFrame, policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Adds `elasticity` by category, with the default for unknown categories.

    No broadcast hint: the lookup is written first, so that Spark knows its size and broadcasts
    it only below the session's limit.
    """
    lookup = staged(
        elasticity.select("category", F.col("elasticity").alias("_e")), "elasticity"
    )
    return (
        rows.join(lookup, "category", "left")
        .withColumn("elasticity", F.coalesce("_e", F.lit(policy.default_elasticity)))
        .drop("_e")
    )


def append_pending(pending: DataFrame, path: str) -> None:
    """Adds escalated recommendations to the review queue."""
    schemas.require(pending, schemas.PENDING, "pending")
    pending.select(*schemas.PENDING.fieldNames()).write.mode("append").parquet(path)


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PENDING).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
