"""Event sequences inside an account, in event-time order.

Every start event begins its own match and ``within`` is strict: the gap from the first to the last
event must be less than the window. ``cuts`` are time cuts as for the account features.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import Running, chunks, running, with_slot
from .common import first_per

KEY = "account_no"
TS = "event_time"
ORDER = [TS, "event_id"]
#: Failures of an account that are stored together as evidence.
EVIDENCE_CHUNK = 64


def _following(df: DataFrame, marks: dict[str, Column], chunk: Sequence[str]) -> DataFrame:
    """Add for each mark the nearest later row of the account that carries it."""
    values = [Running(name, mark, how="last", prior=True) for name, mark in marks.items()]
    return running(df, [KEY], chunk, ORDER, values, descending=True)


def _inside(first: str, last: str, within: timedelta):
    return F.col(last) - F.col(first) < F.lit(within)


def probe_then_large(
    txn: DataFrame,
    probe: int = 10_000,
    large: int = 1_000_000,
    within: timedelta = timedelta(minutes=10),
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Each event of at most ``probe`` paired with the next later event of at least ``large``."""
    slim = txn.select(KEY, *ORDER, "amount_minor", "source_id", "txn_id").filter(
        (F.col("amount_minor") <= probe) | (F.col("amount_minor") >= large)
    )
    mark = F.when(F.col("amount_minor") >= large, F.struct(*ORDER, "amount_minor", "source_id", "txn_id"))
    found = _following(with_slot(slim, TS, "_slot", cuts), {"next_large": mark}, chunks(cuts, "_slot"))
    return (
        found.filter((F.col("amount_minor") <= probe) & F.col("next_large").isNotNull())
        .select(
            KEY,
            F.col("event_id").alias("probe_event_id"),
            F.col(TS).alias("probe_time"),
            F.col("amount_minor").alias("probe_amount"),
            F.col("next_large.event_id").alias("large_event_id"),
            F.col(f"next_large.{TS}").alias("large_time"),
            F.col("next_large.amount_minor").alias("large_amount"),
            F.col("next_large.source_id").alias("source_id"),
            F.col("next_large.txn_id").alias("txn_id"),
        )
        .filter(_inside("probe_time", "large_time", within))
    )


def failed_then_success(
    txn: DataFrame,
    min_failures: int = 3,
    within: timedelta = timedelta(minutes=30),
    collapse: bool = False,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Runs of consecutive failures, then (other events may come between) the next success.

    One row per first failure. The matches it starts differ only in how many failures they take:
    every number from ``min_failures`` to ``failure_count``, hence ``match_count`` of them. Rows
    stay linear in the input; ``expand_matches`` lists the matches one by one. ``collapse`` keeps
    only the longest match of each run.
    """
    slim = with_slot(txn.select(KEY, *ORDER, "status", "source_id", "txn_id"), TS, "_slot", cuts)
    failed = F.col("status") == "FAILED"
    chunk = chunks(cuts, "_slot")
    counted = running(slim, [KEY], chunk, ORDER, [Running("failures_so_far", failed.cast("bigint"))])
    marks = {
        "run_end": F.when(~failed, F.struct(*ORDER, "failures_so_far")),
        "next_success": F.when(F.col("status") == "SUCCESS", F.struct(*ORDER, "source_id", "txn_id")),
    }
    found = _following(counted, marks, chunk).filter(failed & F.col("next_success").isNotNull())
    starts = found.select(
        KEY,
        F.col("event_id").alias("first_event_id"),
        F.col(TS).alias("first_time"),
        F.col("failures_so_far").alias("first_number"),
        (F.col("run_end.failures_so_far") - F.col("failures_so_far") + 1).alias("failure_count"),
        F.col("next_success.event_id").alias("success_event_id"),
        F.col(f"next_success.{TS}").alias("success_time"),
        F.col("next_success.source_id").alias("source_id"),
        F.col("next_success.txn_id").alias("txn_id"),
        F.col("run_end.event_id").alias("run_end_event_id"),
    )
    matched = starts.filter((F.col("failure_count") >= min_failures) & _inside("first_time", "success_time", within))
    if collapse:
        # starts of one run end at the same event; the one with most failures is the earliest in the window
        longest = first_per(matched, [KEY, "run_end_event_id"], [F.col("failure_count").desc()])
        return longest.withColumn("match_count", F.lit(1).cast("bigint")).drop("run_end_event_id")
    return matched.withColumn("match_count", F.col("failure_count") - (min_failures - 1)).drop("run_end_event_id")


def expand_matches(matches: DataFrame, min_failures: int = 3) -> DataFrame:
    """One row per match of ``failed_then_success``; a run of n failures gives up to (n-2)(n-1)/2."""
    return matches.withColumn("failure_count", F.explode(F.sequence(F.lit(min_failures).cast("bigint"), "failure_count"))).drop("match_count")


def run_evidence(matches: DataFrame, every_failure: DataFrame, chunk: int = EVIDENCE_CHUNK) -> DataFrame:
    """Add ``related_event_ids`` to each match of ``failed_then_success``: every failure of its run from the first one
    on, then the success, in order.

    An account's failures are numbered, so a match refers to its evidence by ``first_number`` and ``failure_count``.
    ``every_failure`` is ``failed_then_success`` over the same window with ``min_failures=1``: one row per failure that a
    success follows. Failures are stored once, in chunks of ``chunk`` numbers; a match is joined to the chunks that
    its range of numbers meets and takes its part of each. No row ever holds a run beyond the match's own evidence.
    """
    number = F.col("first_number")
    stored = every_failure.groupBy(KEY, F.floor(number / chunk).alias("_chunk")).agg(
        F.sort_array(F.collect_list(F.struct("first_number", "first_event_id"))).alias("_held")
    )
    last = number + F.col("failure_count") - 1
    asked = matches.withColumn("_chunk", F.explode(F.sequence(F.floor(number / chunk), F.floor(last / chunk))))
    own = F.filter("_held", lambda e: (e["first_number"] >= number) & (e["first_number"] <= last))
    parts = asked.join(stored, [KEY, "_chunk"]).withColumn("_ids", F.transform(own, lambda e: e["first_event_id"]))
    per_match = parts.groupBy(*matches.columns).agg(F.sort_array(F.collect_list(F.struct("_chunk", "_ids"))).alias("_parts"))
    ids = F.flatten(F.transform("_parts", lambda p: p["_ids"]))
    return per_match.withColumn("related_event_ids", F.concat(ids, F.array("success_event_id"))).drop("_parts")


def signals(probes: DataFrame, failures: DataFrame) -> DataFrame:
    """Both patterns as risk signals; failures come with their evidence (``run_evidence``). The id is a hash of the
    signal's parts, so replays repeat it."""
    a = probes.select(
        F.lit("PROBE_THEN_LARGE").alias("signal_type"),
        KEY,
        "source_id",
        "txn_id",
        F.col("large_time").alias("detected_at"),
        F.array("probe_event_id", "large_event_id").alias("related_event_ids"),
        F.create_map(
            F.lit("probeAmount"), F.col("probe_amount").cast("string"), F.lit("largeAmount"), F.col("large_amount").cast("string")
        ).alias("attributes"),
    )
    b = failures.select(
        F.lit("FAILED_THEN_SUCCESS").alias("signal_type"),
        KEY,
        "source_id",
        "txn_id",
        F.col("success_time").alias("detected_at"),
        "related_event_ids",
        F.create_map(
            F.lit("failureCount"), F.col("failure_count").cast("string"), F.lit("matchCount"), F.col("match_count").cast("string")
        ).alias("attributes"),
    )
    return with_signal_ids(a.unionByName(b))


def detections(probes: DataFrame, failures: DataFrame) -> DataFrame:
    """Type, account and time of every signal, without evidence."""
    a = probes.select(F.lit("PROBE_THEN_LARGE").alias("signal_type"), KEY, F.col("large_time").alias("detected_at"))
    b = failures.select(F.lit("FAILED_THEN_SUCCESS").alias("signal_type"), KEY, F.col("success_time").alias("detected_at"))
    return a.unionByName(b)


def with_signal_ids(parts: DataFrame) -> DataFrame:
    """Put the id, a hash of the signal's type, account and events, and the severity in front."""
    ids = F.sha2(F.concat_ws("|", "signal_type", KEY, F.concat_ws("|", "related_event_ids")), 256)
    return parts.select(ids.alias("signal_id"), F.lit("HIGH").alias("severity"), "*")


def signal_summary(signals: DataFrame) -> DataFrame:
    """Signals per type, account and UTC day. Only type, account and time are read, so rows from ``detections`` do as well
    as signals with their evidence."""
    day = F.to_date("detected_at").alias("signal_date")
    return signals.groupBy("signal_type", KEY, day).agg(F.count(F.lit(1)).alias("signals"))
