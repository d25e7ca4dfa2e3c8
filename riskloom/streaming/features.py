"""Account features over a stream, one output row per new event.

The rules match the batch features for events that arrive in order. Late events are kept: they
count for devices, counterparties and the velocity window, but not for a day that is over.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .spill import Sorter

STATE_DAYS = 90
#: Rows of an account that its task handles at a time.
CHUNK_ROWS = 10_000
OUTPUT = T.StructType(
    [
        T.StructField("account_no", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("daily_stat_date", T.DateType()),
        T.StructField("daily_amount", T.LongType()),
        T.StructField("daily_count", T.LongType()),
        T.StructField("txn_count", T.LongType()),
        T.StructField("device_new", T.BooleanType()),
        T.StructField("known_device_count", T.LongType()),
        T.StructField("unique_counterparty_count", T.LongType()),
        T.StructField("feature_event_us", T.LongType()),
    ]
)
_TOTALS = T.StructType(
    [
        T.StructField("day", T.IntegerType()),
        T.StructField("amount", T.LongType()),
        T.StructField("count", T.LongType()),
        T.StructField("newest", T.LongType()),
        T.StructField("devices", T.LongType()),
        T.StructField("counterparties", T.LongType()),
        T.StructField("segments", T.ArrayType(T.ArrayType(T.LongType()))),  # id, first time, last time, events
    ]
)
_BLOCK = T.StructType([T.StructField("run", T.LongType()), T.StructField("block", T.LongType())])
_ID = T.StructType([T.StructField("id", T.LongType())])
_DATA = T.StructType([T.StructField("data", T.BinaryType())])
_TEXT = T.StructType([T.StructField("value", T.StringType())])
_SEEN = T.StructType([T.StructField("seen", T.BooleanType())])
_EPOCH = pd.Timestamp("1970-01-01").date()


def _text(values: pd.Series) -> np.ndarray:
    """Whether a value is neither null nor blank."""
    return np.array([v is not None and v == v and bool(v.strip()) for v in values], dtype=bool)


class AccountFeatures(StatefulProcessor):
    """State of one account: totals, maps of the ids, devices and counterparties seen, and the times of the events
    still in the velocity window, in segments of at most ``chunk_rows`` of which only those are read that a
    window's start may lie in. Rows are put in order through the state (``spill``) and handled in chunks."""

    def __init__(self, window: timedelta, ttl_days: int | None, chunk_rows: int = CHUNK_ROWS) -> None:
        self.window = int(window.total_seconds() * 1_000_000)
        self.ttl = None if ttl_days is None else ttl_days * 86_400_000
        self.chunk_rows = chunk_rows
        self.peak = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _TOTALS, self.ttl)
        self.ids = handle.getMapState("ids", _TEXT, _SEEN, self.ttl)
        self.devices = handle.getMapState("devices", _TEXT, _SEEN, self.ttl)
        self.counterparties = handle.getMapState("counterparties", _TEXT, _SEEN, self.ttl)
        self.times = handle.getMapState("times", _ID, _DATA, self.ttl)
        self.blocks = handle.getMapState("blocks", _BLOCK, _DATA, self.ttl)

    @staticmethod
    def _firsts(state, values: pd.Series) -> np.ndarray:
        """Where a non-blank value is new to the account; new ones are remembered, each is looked up once."""
        new = _text(values) & ~values.duplicated().to_numpy()
        for i in np.flatnonzero(new):
            value = (values.iloc[i],)
            if state.containsKey(value):
                new[i] = False
            else:
                state.updateValue(value, (True,))
        return new

    def _in_window(self, segments: list[list[int]], times: np.ndarray, newest: np.ndarray) -> np.ndarray:
        """Events of the account in the window that ends at each row, rows of this chunk up to it included."""
        start = newest - self.window
        own = np.arange(len(times)) + 1
        count = own - np.minimum(np.searchsorted(times, start, "left"), own)
        for number, low, high, n in segments:
            if low >= start[-1]:
                count += n
            elif high >= start[0]:
                stored = np.frombuffer(bytes(self.times.getValue((number,))[0]), np.int64)
                count += n - np.searchsorted(stored, start, "left")
        return count

    def _kept(self, segments: list[list[int]], times: np.ndarray, start: int) -> list[list[int]]:
        """The segments from now on: those that reach the window, and this chunk's times as one more."""
        kept = []
        for segment in segments:
            if segment[2] >= start:
                kept.append(segment)
            else:
                self.times.removeKey((segment[0],))
        times = times[times >= start]
        if not len(times):
            return kept
        last = kept[-1] if kept else None
        if last and last[3] + len(times) <= self.chunk_rows:  # small ones are put together
            stored = np.frombuffer(bytes(self.times.getValue((last[0],))[0]), np.int64)
            times, number = np.sort(np.concatenate([stored[stored >= start], times])), last[0]
            kept.pop()
        else:
            number = max((s[0] for s in kept), default=-1) + 1
        self.times.updateValue((number,), (times.astype(np.int64).tobytes(),))
        return [*kept, [number, int(times[0]), int(times[-1]), len(times)]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.totals.get()
        day, amount, count, newest, devices, parties, segments = stored if stored is not None else (None, 0, 0, 0, 0, 0, [])
        segments = [list(s) for s in segments]
        sorter = Sorter(self.blocks, ["event_us", "event_id"], self.chunk_rows)
        for chunk in sorter.sorted(rows):
            self.peak = max(self.peak, sorter.peak, len(chunk))
            e = chunk[self._firsts(self.ids, chunk["event_id"])]
            if not len(e):
                continue
            times, amounts = e["event_us"].to_numpy(np.int64), e["amount_minor"].to_numpy(np.int64)
            days = e["event_day"].to_numpy(np.int64)
            # totals of the latest day so far: an event of an earlier day adds nothing
            today = np.maximum.accumulate(days if day is None else np.maximum(days, day))
            counts = days == today
            begins = np.searchsorted(today, today, "left")
            amount_sum, count_sum = np.cumsum(np.where(counts, amounts, 0)), np.cumsum(counts)
            before = begins - 1
            carried = today == day if day is not None else np.zeros(len(e), bool)
            daily_amount = amount_sum - np.where(begins > 0, amount_sum[before], 0) + np.where(carried, amount, 0)
            daily_count = count_sum - np.where(begins > 0, count_sum[before], 0) + np.where(carried, count, 0)
            latest = np.maximum.accumulate(np.maximum(times, newest))
            in_window = self._in_window(segments, times, latest)
            new_device = self._firsts(self.devices, e["device_id"])
            known = devices + np.cumsum(new_device)
            unique = parties + np.cumsum(self._firsts(self.counterparties, e["counterparty"]))
            yield pd.DataFrame(
                {
                    "account_no": key[0],
                    "event_id": e["event_id"].to_numpy(),
                    "daily_stat_date": [_EPOCH + timedelta(days=d) for d in today.tolist()],
                    "daily_amount": daily_amount,
                    "daily_count": daily_count,
                    "txn_count": in_window,
                    "device_new": new_device,
                    "known_device_count": known,
                    "unique_counterparty_count": unique,
                    "feature_event_us": latest,
                }
            )
            day, amount, count, newest = int(today[-1]), int(daily_amount[-1]), int(daily_count[-1]), int(latest[-1])
            devices, parties = int(known[-1]), int(unique[-1])
            segments = self._kept(segments, times, newest - self.window)
        if day is not None:
            self.totals.update((day, amount, count, newest, devices, parties, segments))

    def close(self) -> None:
        pass


def stream_features(
    txn: DataFrame,
    zone: str = "UTC",
    window: timedelta = timedelta(minutes=5),
    ttl_days: int | None = STATE_DAYS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Features per event of a transaction stream. An event that repeats an id of the account gives no row.

    An account's rows of one micro-batch are put in order through its state and handled ``chunk_rows`` at a
    time, so neither their number nor the events in a window bound what a task must hold, and results do not
    depend on how Arrow chunks them. Rows without an id, time or amount are left out.

    State not written for ``ttl_days`` expires by the clock, which keeps a stream's batches coming;
    give None for a run that shall end with its input.
    """
    slim = txn.select(
        "account_no",
        "event_id",
        "amount_minor",
        "device_id",
        "counterparty",
        F.unix_micros("event_time").alias("event_us"),
        F.unix_date(F.to_date(F.from_utc_timestamp("event_time", zone))).alias("event_day"),
    )
    slim = slim.dropna(subset=["event_id", "event_us", "amount_minor"])
    return slim.groupBy("account_no").transformWithStateInPandas(
        statefulProcessor=AccountFeatures(window, ttl_days, chunk_rows),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None" if ttl_days is None else "ProcessingTime",
    )
