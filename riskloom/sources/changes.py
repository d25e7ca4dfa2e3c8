"""Change records and increments of source tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import latest_per


def unwrap_changes(changes: DataFrame) -> DataFrame:
    """Flatten ``before/after/op/source`` change records; a delete keeps its last row and a flag."""
    row = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    return changes.withColumn("_row", row).select(
        "_row.*",
        F.col("op").alias("__op"),
        F.col("source.table").alias("__table"),
        F.col("source.ts_ms").alias("__source_ts_ms"),
        F.col("source.pos").alias("__source_pos"),
        (F.col("op") == "d").alias("__deleted"),
    )


def current_state(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last change per key, deletes flagged."""
    return latest_per(unwrap_changes(changes), keys, ["__source_ts_ms", "__source_pos"])


def increment(df: DataFrame, ts: str, watermark: Column) -> DataFrame:
    """Rows at or after the watermark; a plain predicate, so the source can skip data."""
    return df.filter(F.col(ts) >= watermark)


def read_jdbc_increment(
    spark: SparkSession, url: str, table: str, columns: Sequence[str], ts: str, watermark: Column, **options: str
) -> DataFrame:
    """Increment of a database table; Spark sends the projection and predicate to the database.

    Pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel.
    """
    df = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
    return increment(df.select(*columns), ts, watermark)


def retention_tier(
    df: DataFrame, ts: str, now: Column, warm: timedelta = timedelta(days=7), delete: timedelta = timedelta(days=180)
) -> DataFrame:
    """Add ``tier``: hot, warm or deleted by age."""
    t = F.col(ts)
    return df.withColumn(
        "tier", F.when(t <= now - F.lit(delete), "deleted").when(t <= now - F.lit(warm), "warm").otherwise("hot")
    )


def retained(df: DataFrame, ts: str, now: Column, delete: timedelta = timedelta(days=180)) -> DataFrame:
    """Rows that are not yet due for deletion."""
    return df.filter(F.col(ts) > now - F.lit(delete))
