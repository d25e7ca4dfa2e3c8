"""Running account features over transactions, in event-time order.

Input needs ``event_id``, ``account_no`` and ``event_time``; events must be unique (see
``dedupe_events``). Nothing here depends on how the rows of one account are spread: all values come
from chunked scans (``functions.scan``).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import TARGET_ROWS, Running, chunks, running, with_slot
from ..functions.text import non_blank
from .common import first_per, latest_per
from .snapshots import BEFORE, account_features, window_counts

KEYS = ["account_no"]
ORDER = ["event_time", "event_id"]
CHUNK = ["_day", "_slot"]
VELOCITY = timedelta(minutes=5)
SNAPSHOT = [
    "daily_stat_date",
    "daily_amount",
    "daily_count",
    "txn_count",
    "device_new",
    "known_device_count",
    "unique_counterparty_count",
    "feature_event_time",
]


def dedupe_events(df: DataFrame, arrival: list[str] | None = None) -> DataFrame:
    """The first arrival of each event id."""
    return first_per(df, ["event_id"], arrival or ["event_time"])


def _local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


Cuts = Sequence[float] | None


def _chunked(df: DataFrame, zone: str, cuts: Cuts) -> DataFrame:
    """Cut by local day and by time range; ranges are cut in UTC, so they follow the order in any zone."""
    return with_slot(df.withColumn("_day", F.to_date(_local(F.col("event_time"), zone))), "event_time", "_slot", cuts)


def daily_running(df: DataFrame, zone: str = "UTC", cuts: Cuts = None) -> DataFrame:
    """Add ``daily_amount`` and ``daily_count``: the account's local day up to and with the row."""
    values = [
        Running("daily_amount", F.col("amount_minor"), within=("_day",)),
        Running("daily_count", F.lit(1).cast("bigint"), within=("_day",)),
    ]
    return running(_chunked(df, zone, cuts), KEYS, chunks(cuts, *CHUNK), ORDER, values).drop(*CHUNK)


def velocity(df: DataFrame, window: timedelta = VELOCITY, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add ``txn_count``: the account's events in the window ending at the row.

    Arrivals count up and departures count down, so the cost does not grow with the window.
    """
    return window_counts(df, {"txn_count": window}, target_rows)


def first_sight(df: DataFrame, col: str) -> DataFrame:
    """The first event of each account with each non-blank value of a column."""
    seen = df.filter(non_blank(F.col(col)).isNotNull()).select(*KEYS, col, *ORDER)
    return first_per(seen, [*KEYS, col], ORDER)


def _marked(df: DataFrame, marks: dict[str, str]) -> DataFrame:
    """The rows, and in front of a row one marker per column whose value it shows first."""
    out = df.withColumn("_kind", F.lit(len(marks)))
    for kind, (name, col) in enumerate(marks.items()):
        marker = first_sight(df, col).select(*KEYS, *ORDER, F.lit(kind).alias("_kind"), F.lit(1).cast("bigint").alias(name))
        out = out.unionByName(marker, allowMissingColumns=True)
    return out


def device_new(df: DataFrame) -> DataFrame:
    """Add ``device_new``: the account shows this non-blank device for the first time."""
    first = first_sight(df, "device_id").select("event_id", F.lit(True).alias("device_new"))
    # event ids are unique on both sides, so this join is even
    return df.join(first, "event_id", "left").withColumn("device_new", F.coalesce("device_new", F.lit(False)))


def distinct_running(df: DataFrame, col: str, out: str, cuts: Cuts = None) -> DataFrame:
    """Add the number of distinct non-blank values the account has shown so far."""
    rows = _chunked(_marked(df, {"_first": col}), "UTC", cuts)
    value = F.coalesce("_first", F.lit(0).cast("bigint"))
    res = running(rows, KEYS, chunks(cuts, *CHUNK), [*ORDER, "_kind"], [Running(out, value)])
    return res.filter(F.col("_kind") == 1).select(*df.columns, out)


def feature_snapshot(
    df: DataFrame, zone: str = "UTC", window: timedelta = VELOCITY, cuts: Cuts = None, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Add all account features as they stand right after each event (see ``snapshots``)."""
    return account_features(df, zone, window, cuts, target_rows).drop(*BEFORE)


def features_before(
    df: DataFrame, zone: str = "UTC", window: timedelta = VELOCITY, cuts: Cuts = None, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Add to each event the features stored after its account's previous event, without storing them first:
    the same as ``features_as_of`` over ``feature_snapshot``, in the same scan."""
    scanned = account_features(df, zone, window, cuts, target_rows)
    return scanned.select(*df.columns, *[F.col(f"stored_{c}").alias(c) for c in SNAPSHOT])


def latest_features(snapshot: DataFrame) -> DataFrame:
    """The serving table: the last snapshot of each account."""
    return latest_per(snapshot, KEYS, ORDER).select(*KEYS, *SNAPSHOT)


def features_as_of(snapshot: DataFrame, cuts: Cuts = None) -> DataFrame:
    """Replace each row's features by those stored after the account's previous event.

    The first event of an account finds none. The stored values are stale on purpose: a daily
    total of yesterday stays until the next event rewrites it.
    """
    chunked = _chunked(snapshot, "UTC", cuts)
    stored = Running("_stored", F.struct(*SNAPSHOT), how="last", prior=True)
    out = running(chunked, KEYS, chunks(cuts, *CHUNK), ORDER, [stored])
    payload = [c for c in snapshot.columns if c not in SNAPSHOT]
    return out.select(*payload, *[F.col(f"_stored.{c}").alias(c) for c in SNAPSHOT])


def refreshed(as_of: DataFrame, zone: str = "UTC") -> DataFrame:
    """Features as of now instead of as stored: daily totals of an earlier local day count as zero."""
    today = F.to_date(_local(F.col("event_time"), zone)) == F.col("daily_stat_date")
    zero = F.lit(0).cast("bigint")
    return as_of.withColumns({c: F.when(today, F.col(c)).otherwise(zero) for c in ("daily_amount", "daily_count")})


def model_columns() -> list[Column]:
    """The model's inputs in contract order, from a transaction and its typed features; money in major
    units. Absent daily totals stay absent."""
    return [
        (F.col("amount_minor") / 100.0).alias("amount"),
        (F.col("daily_amount") / 100.0).alias("daily_amount"),
        F.col("daily_count").cast("double").alias("daily_count"),
        F.hour("event_time").cast("double").alias("hour"),
        F.col("counterparty").isNotNull().cast("double").alias("cross_bank"),
        F.coalesce("device_new", F.lit(False)).cast("double").alias("device_new"),
    ]


def model_features(as_of: DataFrame) -> DataFrame:
    """The model's inputs per transaction; daily totals that are not stored yet count as zero."""
    zero = F.lit(0).cast("bigint")
    filled = as_of.withColumns({c: F.coalesce(c, zero) for c in ("daily_amount", "daily_count")})
    return filled.select("event_id", "source_id", "txn_id", *model_columns())


def parity_check(left: DataFrame, right: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows and mismatches per column of two implementations of the same features."""
    columns = [c for c in left.columns if c != key]
    a = left.select(key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a"))
    b = right.select(key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b"))
    both = a.join(b, key, "full")
    one_sided = (F.col("_a").isNull() | F.col("_b").isNull()).cast("bigint")
    counts = [
        F.sum((~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("bigint")).alias(f"mismatch_{c}") for c in columns
    ]
    return both.agg(F.count(F.lit(1)).alias("events"), F.sum(one_sided).alias("one_sided"), *counts)
