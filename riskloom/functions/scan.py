"""Running values over ordered keys without putting a whole key into one task.

Rows of a key are cut into chunks that follow the order (time ranges, value ranges). Each chunk is
summarised with a partially aggregated ``groupBy``; only those summaries are accumulated per key.
The result enters every chunk as one extra "seed" row in front, so a window over (key, chunk)
yields the values a window over the whole key would, with one shuffle of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600
#: Rows of one chunk; every number of chunks or ranges follows from it and a row count.
TARGET_ROWS = 2_000_000


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` is sum, max, last (ignoring nulls) or total, the sum over the whole key.

    ``within`` names chunk columns at whose change the value starts anew; ``prior`` leaves out
    the current row.
    """

    name: str
    value: Column
    how: str = "sum"
    within: tuple[str, ...] = ()
    prior: bool = False


def _over(how: str, c: Column, w) -> Column:
    if how == "last":
        return F.last(c, ignorenulls=True).over(w)
    return (F.max(c) if how == "max" else F.sum(c)).over(w)


def _windowed(df: DataFrame, keys: list[str], order: list[str], values: Sequence[Running], descending: bool) -> DataFrame:
    def value(v: Running) -> Column:
        w = Window.partitionBy(*([*keys, *v.within] or [F.lit(0)]))
        if v.how != "total":
            w = w.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in order])
            w = w.rowsBetween(Window.unboundedPreceding, -1 if v.prior else Window.currentRow)
        return _over(v.how, v.value, w).alias(v.name)

    return df.select("*", *[value(v) for v in values])


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[str],
    values: Sequence[Running],
    descending: bool = False,
) -> DataFrame:
    """Add the running values. ``order`` columns must not be null and must identify a row within its
    key; a later chunk must hold only later rows. ``descending`` runs from the last row to the first.

    Without chunk columns a key is one task's, as is right for keys of usual size (see ``by_weight``): one shuffle.
    """
    keys, chunk, order = list(keys), list(chunk), list(order)
    if not chunk:
        return _windowed(df, keys, order, values, descending)
    rows = df.select("*", *[v.value.alias(f"_in_{v.name}") for v in values])

    def c_name(v: Running) -> str:
        return f"_in_{v.name}"

    def summary(v: Running) -> Column:
        c = F.col(c_name(v))
        if v.how == "last":
            outermost = F.min_by if descending else F.max_by
            return outermost(c, F.when(c.isNotNull(), F.struct(*order))).alias(c_name(v))
        return (F.max(c) if v.how == "max" else F.sum(c)).alias(c_name(v))

    def sort(columns: Sequence[str]) -> list[Column]:
        # seeds have no order values and come first
        return [F.col(c).desc_nulls_first() if descending else F.col(c).asc_nulls_first() for c in columns]

    totals = rows.groupBy(*keys, *chunk).agg(*[summary(v) for v in values])
    carried = []
    for v in values:
        group = [*keys, *v.within] or [F.lit(0)]
        w = Window.partitionBy(*group)
        if v.how != "total":
            w = w.orderBy(*sort(chunk)).rowsBetween(Window.unboundedPreceding, -1)
        carried.append(_over(v.how, F.col(c_name(v)), w).alias(c_name(v)))
    seeds = totals.select(*keys, *chunk, *carried).withColumn("_seed", F.lit(True))

    only_seeded = [c_name(v) for v in values if v.how == "total"]
    everything = rows.drop(*only_seeded).withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    base = Window.partitionBy(*keys, *chunk).orderBy(*sort(order))
    upto = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = base.rowsBetween(Window.unboundedPreceding, -1)

    def value(v: Running) -> Column:
        # a total stands in the seed alone, so adding up the chunk keeps it
        return _over(v.how, F.col(c_name(v)), before if v.prior else upto).alias(v.name)

    out = everything.select(*df.columns, "_seed", *[value(v) for v in values])
    return out.filter(~F.col("_seed")).drop("_seed")


def cut_points(counted: int, target_rows: int) -> list[float]:
    """Probabilities that cut a table of ``counted`` rows into parts of about ``target_rows``."""
    parts = max(1, -(-counted // target_rows))
    return [i / parts for i in range(1, parts)]


def heavy_keys(df: DataFrame, key: str, target_rows: int = TARGET_ROWS) -> list[str]:
    """Values of a key column with more than ``target_rows`` rows: at most one per that many rows of the table.

    Tables below the target have none and cost one count; others are counted by key with partial sums.
    """
    if df.count() <= target_rows:
        return []
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return sorted(r[key] for r in counts.filter(F.col("rows") > target_rows).select(key).collect())


def time_cuts(df: DataFrame, ts: str, window: timedelta | None = None, target_rows: int = TARGET_ROWS) -> list[float]:
    """Instants (in microseconds) that cut the rows into time ranges of about ``target_rows`` rows.

    No chunk cut at them can hold much more than that, whatever share of the rows one key or one hour
    has; the number of ranges follows the number of rows. A scan that also counts rows out at the end of
    a ``window`` names it here. Tables below the target need no cuts and no pass over their times. The
    driver sees only the cut points.
    """
    instants = [F.col(ts)] if window is None else [F.col(ts), F.col(ts) + F.lit(window)]
    probs = cut_points(df.count() * len(instants), target_rows)
    if not probs:
        return []
    micros = df.select(F.explode(F.array(*[F.unix_micros(t).cast("double") for t in instants])).alias("t"))
    return sorted(set(micros.approxQuantile("t", probs, 0.25 / (len(probs) + 1))))


def with_slot(df: DataFrame, ts: str, out: str = "_slot", cuts: Sequence[float] | None = None) -> DataFrame:
    """Add the number of the time range a row lies in: between the given cuts (none: one range), or by hour without any given."""
    if cuts is not None and not cuts:
        return df.withColumn(out, F.lit(0.0))
    if cuts is None:
        return df.withColumn(out, F.floor(F.unix_micros(ts) / F.lit(HOUR * 1_000_000)).cast("double"))
    splits = [float("-inf"), *cuts, float("inf")]
    timed = df.withColumn("_micros", F.unix_micros(ts).cast("double"))
    return Bucketizer(splits=splits, inputCol="_micros", outputCol=out).transform(timed).drop("_micros")


def value_cuts(df: DataFrame, col: str, target_rows: int = TARGET_ROWS) -> list[float]:
    """Values that cut a numeric column into ranges of about ``target_rows`` rows; none for a table below the target."""
    probs = cut_points(df.count(), target_rows)
    return sorted(set(df.approxQuantile(col, probs, 0.5 / (len(probs) + 1)))) if probs else []


def chunks(cuts: Sequence[float] | None, *names: str) -> list[str]:
    """The chunk columns of a scan: those named, or none where nothing is cut."""
    return [] if cuts is not None and not cuts else list(names)


def by_weight(
    df: DataFrame,
    key: str,
    ts: str,
    scan: Callable[[DataFrame, list[float]], DataFrame],
    window: timedelta | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Scan the keys of usual size whole and cut only the heavy ones, which have more than ``target_rows`` rows each.

    ``scan`` takes rows and time cuts; without cuts every key is one task's.
    """
    heavy = heavy_keys(df, key, target_rows)
    if not heavy:
        return scan(df, [])
    chosen = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    large = df.filter(chosen)
    return scan(df.filter(~chosen), []).unionByName(scan(large, time_cuts(large, ts, window, target_rows)))


def value_ranges(
    df: DataFrame, col: str, out: str, target_rows: int = TARGET_ROWS, cuts: Sequence[float] | None = None
) -> DataFrame:
    """Cut a numeric column into ranges of about ``target_rows`` rows, numbered upward.

    The cuts are taken over all rows; a key with few values lies in few ranges, none of which exceeds the target. The driver sees only the cut points, which
    are then constants of the plan, so every evaluation cuts alike.
    """
    cuts = value_cuts(df, col, target_rows) if cuts is None else cuts
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)
