"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, prepare, release, shared_path

__all__ = ["materialize", "parts_for", "prepare", "put_back", "quoted", "release", "row_numbers", "set_aside", "shared_path", "table", "text_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def set_aside(docs: DataFrame, text: str, **named: Column) -> DataFrame:
    """The columns of ``docs`` in one struct ``_rest``, but for the text, which is ``_body``, and further columns as named.

    What an operator adds to the result cannot clash with a column of the input, whatever its name.
    """
    others = [F.col(quoted(c)) for c in docs.columns if c != text]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    return docs.select(rest.alias("_rest"), F.col(quoted(text)).alias("_body"), *[c.alias(n) for n, c in named.items()])


def put_back(aside: DataFrame, columns: Sequence[str], text: str, body: Column | None = None) -> list[Column]:
    """The columns of the input again, in order, with ``body`` (the text as it was by default) in place of the text."""
    body = F.col("_body") if body is None else body
    return [(body if c == text else F.col(f"_rest.{quoted(c)}")).alias(c) for c in columns]


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """Bytes of text in the whole table: one pass over one column, one number to the driver."""
    return int(df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0)


def parts_for(df: DataFrame, size: float, target: float) -> int:
    """Number of parts of about ``target`` each, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / target), 1)


def row_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of a task with the number of their first row; numbers are unique in the whole table."""
    at = TaskContext.get().partitionId() << 36
    for batch in batches:
        yield at, batch
        at += batch.num_rows
