"""Account features after and before each event, from one exploded scan.

Every event becomes two rows, its arrival and its departure from the velocity window; the departure carries
nothing else. They are shuffled once, by account, and windows over the shuffled rows give the first sights,
the running values, and by the previous event's values what was stored when the event came in.

An account with more than ``target_rows`` events is heavy. There are at most ``rows / target_rows`` of them. Their rows
are shuffled by account, day and time range instead. A range then knows its own sums, and which of its
first sights are first overall from the ranges in which a value was first seen. Its local values are written to the shared
folder; one row per range, with its sums and its last event, is accumulated per account and
joined back. So an account's size is never the size of a task, and accounts of usual size pay nothing for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import TARGET_ROWS, heavy_keys, time_cuts, with_slot
from ..functions.text import non_blank
from ..session import materialize

KEYS = ["account_no"]
CHUNK = ["_day", "_slot"]
#: Values that add up from range to range; the last two follow from first sights.
SUMS = ["daily_amount", "daily_count", "txn_count", "known_device_count", "unique_counterparty_count"]
AFTER = ["daily_stat_date", *SUMS, "device_new", "feature_event_time"]
#: The same, as stored by the account's previous event.
BEFORE = [f"stored_{c}" for c in AFTER]
_SIGHTS = {"_dev": "device_id", "_cp": "counterparty"}

Cuts = Sequence[float] | None


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def exploded(df: DataFrame, windows: Sequence[timedelta]) -> DataFrame:
    """Arrivals (``_kind`` 0) with all columns and, per window, a departure that keeps account, id and its time.

    A window's lower bound is inclusive, so at equal times arrivals come before departures.
    """
    kinds = F.explode(F.array(*[F.lit(k) for k in range(len(windows) + 1)]))
    rows = df.select("*", kinds.alias("_kind"))
    leaves = F.col("event_time")
    for k, window in enumerate(windows, 1):
        leaves = F.when(F.col("_kind") == k, F.col("event_time") + F.lit(window)).otherwise(leaves)
    slim = {c: F.when(F.col("_kind") == 0, F.col(c)) for c in df.columns if c not in (*KEYS, "event_time", "event_id")}
    return rows.withColumns({**slim, "event_time": leaves})


def _shown(col: str) -> Column:
    return non_blank(F.col(col)).isNotNull()


def _first_ranges(df: DataFrame, zone: str, cuts: Cuts) -> DataFrame:
    """One marker per account and value, in the range of the value's first sight."""
    seen = F.explode(
        F.array(*[F.struct(F.lit(name).alias("mark"), F.when(_shown(c), F.col(c)).alias("value")) for name, c in _SIGHTS.items()])
    )
    first = (
        df.select(*KEYS, "event_time", seen.alias("x"))
        .select(*KEYS, "event_time", "x.*")
        .filter(F.col("value").isNotNull())
        .groupBy(*KEYS, "mark", "value")
        .agg(F.min("event_time").alias("event_time"))
    )
    values = [F.when(F.col("mark") == name, F.col("value")).alias(c) for name, c in _SIGHTS.items()]
    marked = with_slot(first.withColumn("_day", local_day(F.col("event_time"), zone)), "event_time", "_slot", cuts)
    return marked.select(*KEYS, *CHUNK, "mark", *values)


def _scanned(rows: DataFrame, part: Sequence[str], marked: bool) -> DataFrame:
    """Running values of ``SUMS`` within ``part``, with those of the previous event there.

    ``rows`` have ``_kind`` and ``_day``. With markers a sight counts only where its marker lies in the part.
    """
    part = list(part)
    arrival = F.col("_kind") == 0
    if marked:
        arrival = arrival & F.col("mark").isNull()
    sights = {}
    for name, c in _SIGHTS.items():
        # markers have no time and come first
        same = Window.partitionBy(*part, c).orderBy(F.col("event_time").asc_nulls_first(), "_kind", "event_id")
        upto = same.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = F.when(arrival & _shown(c), 1)
        first = F.coalesce((own == 1) & (F.count(own).over(upto) == 1), F.lit(False))
        if marked:
            first = first & (F.count(F.when(F.col("mark") == name, 1)).over(upto) > 0)
        sights[name] = first
    for name, first in sights.items():
        rows = rows.withColumn(name, first)
    if marked:
        rows = rows.filter(F.col("mark").isNull()).drop("mark")
        arrival = F.col("_kind") == 0
    line = ["_day", "event_time", "_kind", "event_id"]
    along = Window.partitionBy(*part).orderBy(*line)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    day = Window.partitionBy(*dict.fromkeys([*part, "_day"])).orderBy(*line[1:]).rowsBetween(Window.unboundedPreceding, 0)
    one = F.lit(1).cast("bigint")

    def count(c: str) -> Column:
        return F.sum(F.col(c).cast("bigint")).over(upto)

    rows = rows.withColumns(
        {
            "txn_count": F.sum(F.when(arrival, one).otherwise(-one)).over(upto),
            "known_device_count": count("_dev"),
            "unique_counterparty_count": count("_cp"),
        }
    ).withColumns(
        {
            "daily_amount": F.sum(F.when(arrival, F.col("amount_minor"))).over(day),
            "daily_count": F.sum(F.when(arrival, one).otherwise(one - one)).over(day),
        }
    )
    after = F.struct(
        F.col("_day").alias("daily_stat_date"), *SUMS, F.col("_dev").alias("device_new"), F.col("event_time").alias("feature_event_time")
    )
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.last(F.when(arrival, after), ignorenulls=True).over(earlier))


def _light(df: DataFrame, zone: str, window: timedelta) -> DataFrame:
    """Accounts of usual size: one shuffle by account."""
    rows = exploded(df, [window]).withColumn("_day", local_day(F.col("event_time"), zone)).repartition(*KEYS)
    out = _scanned(rows, KEYS, marked=False).filter(F.col("_kind") == 0)
    return out.select(
        *df.columns,
        F.col("_day").alias("daily_stat_date"),
        *SUMS,
        F.col("_dev").alias("device_new"),
        F.col("event_time").alias("feature_event_time"),
        *[F.col(f"_before.{c}").alias(f"stored_{c}") for c in AFTER],
    )


def _plus(local: Column, carried: Column) -> Column:
    return F.coalesce(local + carried, local, carried)


def _ranged(df: DataFrame, zone: str, window: timedelta, cuts: Cuts) -> DataFrame:
    """Accounts of any size, cut by local day and time range."""
    rows = exploded(df, [window]).withColumn("_day", local_day(F.col("event_time"), zone))
    rows = with_slot(rows, "event_time", "_slot", cuts).withColumn("mark", F.lit(None).cast("string"))
    rows = rows.unionByName(_first_ranges(df, zone, cuts), allowMissingColumns=True).repartition(*KEYS, *CHUNK)
    part = [*KEYS, *CHUNK]
    last = Window.partitionBy(*part).orderBy("_kind", F.desc("event_time"), F.desc("event_id"))
    local = _scanned(rows, part, marked=True)
    local = local.withColumn("_last", (F.row_number().over(last) == 1) & (F.col("_kind") == 0))
    local = materialize(local, "account-ranges")

    # one row per account and range: what its rows add, and the values at its last event
    arrival, one = F.col("_kind") == 0, F.lit(1).cast("bigint")
    added = {
        "daily_amount": F.sum(F.when(arrival, F.col("amount_minor"))),
        "daily_count": F.sum(F.when(arrival, one).otherwise(one - one)),
        "txn_count": F.sum(F.when(arrival, one).otherwise(-one)),
        "known_device_count": F.sum(F.col("_dev").cast("bigint")),
        "unique_counterparty_count": F.sum(F.col("_cp").cast("bigint")),
    }
    at_last = [F.sum(F.when(F.col("_last"), F.col(c))).alias(f"_last_{c}") for c in SUMS]
    ranges = local.groupBy(*part).agg(
        *[c.alias(f"_add_{name}") for name, c in added.items()],
        *at_last,
        F.max(F.when(F.col("_last"), F.unix_micros("event_time"))).alias("_last_time"),
        F.max(F.when(F.col("_last"), F.col("_dev").cast("int"))).alias("_last_new"),
    )
    account = Window.partitionBy(*KEYS).orderBy(*CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy(*KEYS, "_day").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = {c: F.sum(f"_add_{c}").over(day if c.startswith("daily") else account) for c in SUMS}
    ranges = ranges.withColumns({f"_in_{c}": x for c, x in carried.items()})
    final = F.struct(
        F.col("_day").alias("daily_stat_date"),
        *[_plus(F.col(f"_last_{c}"), F.col(f"_in_{c}")).alias(c) for c in SUMS],
        (F.col("_last_new") == 1).alias("device_new"),
        F.timestamp_micros("_last_time").alias("feature_event_time"),
    )
    handed = F.last(F.when(F.col("_last_time").isNotNull(), final), ignorenulls=True).over(account)
    ranges = ranges.select(*part, *[f"_in_{c}" for c in SUMS], handed.alias("_handed"))

    events = local.filter(arrival).join(ranges, part)
    inside = F.col("_before").isNotNull()

    def before(c: str) -> Column:
        own = F.col(f"_before.{c}")
        return F.when(inside, _plus(own, F.col(f"_in_{c}")) if c in SUMS else own).otherwise(F.col(f"_handed.{c}"))

    # daily totals of an earlier day in the same part cannot occur: a range lies within one day
    return events.select(
        *df.columns,
        F.col("_day").alias("daily_stat_date"),
        *[_plus(F.col(c), F.col(f"_in_{c}")).alias(c) for c in SUMS],
        F.col("_dev").alias("device_new"),
        F.col("event_time").alias("feature_event_time"),
        *[before(c).alias(f"stored_{c}") for c in AFTER],
    )


def account_features(
    df: DataFrame, zone: str, window: timedelta, cuts: Cuts = None, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Add ``AFTER``, the account's features right after each event, and ``BEFORE``, those stored by its previous event.

    Events need unique ids. With ``cuts`` all accounts are cut at them, otherwise only those above ``target_rows``.
    """
    if cuts is not None:
        return _ranged(df, zone, window, cuts)
    heavy = heavy_keys(df, KEYS[0], target_rows)
    if not heavy:
        return _light(df, zone, window)
    chosen = F.coalesce(F.col(KEYS[0]).isin(heavy), F.lit(False))
    large = df.filter(chosen)
    ranged = _ranged(large, zone, window, time_cuts(large, "event_time", window, target_rows))
    return _light(df.filter(~chosen), zone, window).unionByName(ranged)


def window_counts(df: DataFrame, windows: dict[str, timedelta], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add, per name, the account's events in the window that ends at the row; all windows in one scan."""
    heavy = heavy_keys(df, KEYS[0], target_rows)
    chosen = F.coalesce(F.col(KEYS[0]).isin(heavy), F.lit(False)) if heavy else F.lit(False)
    names = list(windows)
    line = ["event_time", "_kind", "event_id"]
    change = [F.when(F.col("_kind") == 0, 1).when(F.col("_kind") == k, -1).otherwise(0).cast("bigint") for k in range(1, len(names) + 1)]

    def counted(rows: DataFrame, part: list[str]) -> DataFrame:
        along = Window.partitionBy(*part).orderBy(*line).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(c).over(along) for n, c in zip(names, change)})

    rows = exploded(df.filter(~chosen) if heavy else df, list(windows.values())).repartition(*KEYS)
    out = counted(rows, KEYS).filter(F.col("_kind") == 0).select(*df.columns, *names)
    if not heavy:
        return out
    large = df.filter(chosen)
    cuts = time_cuts(large, "event_time", max(windows.values()), target_rows)
    rows = with_slot(exploded(large, list(windows.values())), "event_time", "_slot", cuts)
    sums = rows.groupBy(*KEYS, "_slot").agg(*[F.sum(c).alias(f"_in_{n}") for n, c in zip(names, change)])
    earlier = Window.partitionBy(*KEYS).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*KEYS, "_slot", *[F.sum(f"_in_{n}").over(earlier).alias(f"_in_{n}") for n in names])
    local = counted(rows.repartition(*KEYS, "_slot"), [*KEYS, "_slot"]).filter(F.col("_kind") == 0)
    joined = local.join(sums, [*KEYS, "_slot"])
    return out.unionByName(joined.select(*df.columns, *[_plus(F.col(n), F.col(f"_in_{n}")).alias(n) for n in names]))
