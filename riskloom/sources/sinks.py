"""Keyed and partitioned sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versioned import BUCKETS, put, read_version, upsert


def daily_index(df: DataFrame, ts: str = "event_time") -> DataFrame:
    """Add the UTC day the row is filed under."""
    return df.withColumn("event_date", F.to_date(ts))


def write_daily_partitions(df: DataFrame, path: str, columns: Sequence[str], ts: str = "event_time") -> None:
    """Write the selected columns under one folder per UTC day, replacing only the days present.

    Rows are rebalanced by day: a day goes to one task, and a busy day to as many as its size asks for.
    """
    out = daily_index(df, ts).select(*columns, "event_date").hint("rebalance", "event_date")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def json_documents(df: DataFrame, key: str, beside: Sequence[str] = ()) -> DataFrame:
    """One JSON document per key; columns named in ``beside`` are also given on their own."""
    return df.select(F.col(key).alias("doc_id"), F.to_json(F.struct(*df.columns)).alias("document"), *beside)


def read_daily_partitions(spark: SparkSession, path: str) -> DataFrame:
    """The rows filed by day, with the day as ``event_date``."""
    return spark.read.parquet(path)


def write_batch(
    df: DataFrame, path: str, batch_id: int, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS
) -> None:
    """Put one batch of a stream into a keyed table: its last row per key, unless a later one is stored.

    What is written follows the batch, not the table, and a batch that is delivered again changes nothing. Versions before
    the last two are dropped, as nobody else would do that while the stream runs.
    """
    put(df.sparkSession, path, df, keys, order, buckets, batch=("stream", batch_id))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The current row of each key: the newest version, with what a stream has put on it."""
    rows = read_version(spark, path)
    if rows is None:
        raise FileNotFoundError(path)
    return rows


def write_documents(spark: SparkSession, path: str, rows: DataFrame, key: str, order: Sequence[str]) -> None:
    """File one JSON document per key; a document replaces the one of its key unless that is later by ``order``.

    The columns of ``order`` are kept beside the document. Filing the same rows again changes no document.
    """
    upsert(spark, path, json_documents(rows, key, order), ["doc_id"], order)
