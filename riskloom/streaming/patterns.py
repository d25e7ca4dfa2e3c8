"""Event sequences over a stream.

Events wait until the watermark has passed them and are then taken in event-time order; events
behind the watermark are dropped. The matches equal those of the batch patterns.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.patterns import with_signal_ids
from .runtime import LATENESS

OUTPUT = T.StructType(
    [
        T.StructField("signal_type", T.StringType()),
        T.StructField("account_no", T.StringType()),
        T.StructField("first_event_id", T.StringType()),
        T.StructField("last_event_id", T.StringType()),
        T.StructField("first_us", T.LongType()),
        T.StructField("last_us", T.LongType()),
        T.StructField("first_value", T.LongType()),
        T.StructField("last_value", T.LongType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("txn_id", T.StringType()),
        T.StructField("related_event_ids", T.ArrayType(T.StringType())),
    ]
)
_EVENT = T.StructType(
    [
        T.StructField("us", T.LongType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("amount", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("txn_id", T.StringType()),
    ]
)
_START = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("us", T.LongType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("value", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
_WAITING = ["event_us", "event_id", "amount_minor", "status", "source_id", "txn_id"]
_COUNT = T.StructType([T.StructField("failures", T.LongType())])


class AccountPatterns(StatefulProcessor):
    """State of one account: waiting events, starts of open matches, and a failure counter."""

    def __init__(self, probe: int, large: int, probe_within: timedelta, failures: int, failed_within: timedelta) -> None:
        self.probe, self.large, self.min_failures = probe, large, failures
        self.windows = {"probe": _micros(probe_within), "failed": _micros(failed_within)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.starts = handle.getListState("starts", _START)
        self.counter = handle.getValueState("counter", _COUNT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            self.waiting.appendList(list(chunk[_WAITING].itertuples(index=False, name=None)))
            self._wake_after(int(chunk["event_us"].min()))
        yield pd.DataFrame(columns=OUTPUT.names)

    def _wake_after(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(e) for e in self.waiting.get())
        ready, left = [e for e in events if e[0] <= passed], [e for e in events if e[0] > passed]
        if ready:
            yield pd.DataFrame(self._advance(key[0], ready), columns=OUTPUT.names)
            self.waiting.put(left) if left else self.waiting.clear()
        if left:
            self._wake_after(left[0][0])

    def _advance(self, account: str, events: list[tuple]) -> list[tuple]:
        """Take events in order. Every start enters and leaves its queue once."""
        kinds = {"probe": deque(), "run": deque(), "failed": deque()}  # run: failures of the current run
        for s in self.starts.get():
            kinds[s[0]].append(tuple(s[1:]))
        probes, run, failed = kinds.values()
        failures = self.counter.get()[0] if self.counter.exists() else 0
        out = []
        for us, event_id, amount, status, *origin in events:
            for queue, window in ((probes, "probe"), (run, "failed"), (failed, "failed")):
                while queue and us - queue[0][0] >= self.windows[window]:
                    queue.popleft()
            if amount >= self.large:
                out += [("PROBE_THEN_LARGE", account, s[1], event_id, s[0], us, s[2], amount, *origin, [s[1], event_id]) for s in probes]
                probes.clear()
            if amount <= self.probe:
                probes.append((us, event_id, amount, 0))
            if status == "FAILED":
                failures += 1
                run.append((us, event_id, failures, 0))
                continue
            # the run is over: a start's length is the failures from it on
            failed.extend((*s[:3], failures - s[2] + 1) for s in run)
            run.clear()
            if status == "SUCCESS":
                # the failures of a start's run follow it in the queue
                ids = [s[1] for s in failed]
                for i, s in enumerate(failed):
                    if s[3] >= self.min_failures:
                        evidence = [*ids[i : i + s[3]], event_id]
                        out.append(("FAILED_THEN_SUCCESS", account, s[1], event_id, s[0], us, s[3], s[3] - self.min_failures + 1, *origin, evidence))
                failed.clear()
        left = [(kind, *s) for kind, queue in kinds.items() for s in queue]
        self.starts.put(left) if left else self.starts.clear()
        self.counter.update((failures,))
        return out

    def close(self) -> None:
        pass


def _micros(window: timedelta) -> int:
    return int(window.total_seconds() * 1_000_000)


def stream_patterns(
    txn: DataFrame,
    probe: int = 10_000,
    large: int = 1_000_000,
    probe_within: timedelta = timedelta(minutes=10),
    min_failures: int = 3,
    failed_within: timedelta = timedelta(minutes=30),
    lateness: str = LATENESS,
) -> DataFrame:
    """Both patterns over a transaction stream, each match once its last event is behind the watermark.

    For failures, ``first_value`` is the failure count and ``last_value`` the number of matches. The last
    event's source and transaction, and all events of the match in order, come with it.
    """
    slim = (
        txn.withWatermark("event_time", lateness)
        .select("account_no", "event_id", "amount_minor", "status", "source_id", "txn_id", "event_time", F.unix_micros("event_time").alias("event_us"))
    )
    processor = AccountPatterns(probe, large, probe_within, min_failures, failed_within)
    return slim.groupBy("account_no").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def stream_signals(found: DataFrame) -> DataFrame:
    """Streamed matches as risk signals, with the ids that the batch signals have."""
    probe = F.col("signal_type") == "PROBE_THEN_LARGE"
    first, last = F.col("first_value").cast("string"), F.col("last_value").cast("string")
    attributes = F.when(probe, F.create_map(F.lit("probeAmount"), first, F.lit("largeAmount"), last)).otherwise(
        F.create_map(F.lit("failureCount"), first, F.lit("matchCount"), last)
    )
    parts = found.select(
        "signal_type",
        "account_no",
        "source_id",
        "txn_id",
        F.timestamp_micros("last_us").alias("detected_at"),
        "related_event_ids",
        attributes.alias("attributes"),
    )
    return with_signal_ids(parts)
