"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task should get at most.
TARGET_ROWS = 2_000_000


def heavy_salts(counts: DataFrame, on: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """The keys with more than ``target_rows`` rows, from a count ``_rows`` per key, with the salts each needs."""
    salts = F.ceil(F.col("_rows") / target_rows).cast("int").alias("_salts")
    return counts.filter(F.col("_rows") > target_rows).select(*on, salts)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    target_rows: int = TARGET_ROWS,
    heavy: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Join a left side that may have hot keys to a right side that has one row per key.

    The rows per key are counted first (with partial sums, so a hot key does not travel). Without a key
    above ``target_rows`` this is a plain join, and the planner may broadcast. Otherwise the rows of
    every heavy key are spread over as many salts as it has targets, by a hash of ``spread_by``, and only
    the right rows of heavy keys are repeated. ``how`` is inner, left, left_semi or left_anti. A caller that has
    counted already passes ``heavy`` (``heavy_salts``), and the left side is not read for it; one that knows
    the left side's ``rows`` saves the count by key where they are below the target.
    """
    if rows is not None and rows <= target_rows:
        return left.join(right, list(on), how)
    if heavy is None:
        heavy = heavy_salts(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")), on, target_rows)
    if heavy.isEmpty():
        return left.join(right, list(on), how)
    # at most one heavy key per target_rows rows, so this side is small beside either input
    marked = left.join(heavy, list(on), "left")
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")).otherwise(F.lit(0))
    spread = marked.withColumn("_salt", salt).drop("_salts")
    last = F.coalesce(F.col("_salts"), F.lit(1)) - 1
    repeated = right.join(heavy, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_salts")
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")
