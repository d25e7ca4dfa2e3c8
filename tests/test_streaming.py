"""Streams against the batch operators, restart from a checkpoint, and replay-safe sinks."""

from __future__ import annotations

import random
from datetime import timedelta
from hashlib import sha256
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import features, patterns
from riskloom.plans import load
from riskloom.sources import versioned
from riskloom.sources.sinks import read_latest, write_batch
from riskloom.sources.versioned import rebucket, version
from riskloom.streaming import features as sfeatures
from riskloom.streaming import patterns as spatterns
from riskloom.streaming import runtime, windows
from riskloom.streaming.sinks import keyed_sink

from .test_features import COLUMNS, accumulate, random_events


@pytest.fixture
def event_files(spark, txn, tmp_path):
    """Random events in order, as a folder of files to be streamed one by one."""
    events = random_events(11, n=120)
    folder = tmp_path / "in"
    df = txn([(e, a, t.isoformat(), m, d, c, "FAILED" if i % 4 else "SUCCESS") for i, (e, a, t, m, d, c) in enumerate(events)])
    parts = [df.filter(F.col("event_id").isin([e[0] for e in events[i : i + 40]])) for i in range(0, 120, 40)]

    def write(*numbers):
        for n in numbers:
            parts[n].coalesce(1).write.mode("append").parquet(str(folder))
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    runtime.prepare_streaming(spark)
    return df, write


def values(df):
    return {r.event_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_restart_continues_and_equals_batch(event_files, tmp_path):
    df, write = event_files
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for numbers in [(0, 1), (2,)]:
        result = runtime.run_to_table(sfeatures.stream_features(write(*numbers), ttl_days=None), out, checkpoint)
    expected = values(features.feature_snapshot(df))
    assert values(result) == expected and result.count() == 120


@pytest.mark.parametrize("records", ["7", "10000"])
def test_features_do_not_depend_on_arrow_chunks(spark, txn, tmp_path, records):
    events = [(e, "a", *rest) for e, _, *rest in random_events(12, n=60)]
    df = txn([(e, a, t.isoformat(), m, d, c) for e, a, t, m, d, c in events])
    folder, key = str(tmp_path / "in"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    df.orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(folder)
    runtime.prepare_streaming(spark)
    before = spark.conf.get(key)
    spark.conf.set(key, records)
    try:
        stream = sfeatures.stream_features(spark.readStream.schema(df.schema).parquet(folder), ttl_days=None, chunk_rows=9)
        got = runtime.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    finally:
        spark.conf.set(key, before)
    assert values(got) == values(features.feature_snapshot(df)) and got.count() == 60


def test_late_pattern_event_is_dropped_and_signals_are_filed_once(spark, txn, tmp_path):
    rows = [("e-1", "a", "2026-07-22T01:00:00", 10), ("e-3", "a", "2026-07-22T02:00:00", 5), ("e-2", "a", "2026-07-22T01:01:00", 5_000_000),
            ("e-4", "a", "2026-07-22T02:01:00", 2_000_000), ("e-5", "a", "2026-07-22T09:00:00", 20_000)]
    df = txn(rows)
    runtime.prepare_streaming(spark)
    folder, sink, checkpoint = str(tmp_path / "in"), str(tmp_path / "sink"), str(tmp_path / "cp")
    for event, *_ in rows:
        df.filter(F.col("event_id") == event).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).parquet(folder)
        signals = spatterns.stream_signals(spatterns.stream_patterns(stream))
        runtime.run_batches(signals, keyed_sink(sink, ["signal_id"], ["detected_at"]), checkpoint)
    # e-2 came an hour behind the watermark, so e-1 has no large transfer after it
    (signal,) = read_latest(spark, sink).collect()
    batch = patterns.probe_then_large(df.filter("event_id <> 'e-2'"))
    none = patterns.failed_then_success(df)
    assert signal.related_event_ids == ["e-3", "e-4"]
    assert signal.signal_id == patterns.signals(batch, patterns.run_evidence(none, none)).first().signal_id


def test_streamed_patterns_equal_batch_behind_the_watermark(event_files, spark, tmp_path):
    df, write = event_files
    wide = dict(probe=20, large=80)
    stream = spatterns.stream_patterns(write(0, 1, 2), **wide, probe_within=timedelta(hours=2), failed_within=timedelta(hours=6))
    got = runtime.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    limit = df.agg(F.max("event_time") - F.expr("INTERVAL 2 MINUTES")).scalar()
    probes = patterns.probe_then_large(df, within=timedelta(hours=2), **wide).filter(F.col("large_time") <= limit)
    failures = patterns.failed_then_success(df, within=timedelta(hours=6)).filter(F.col("success_time") <= limit)
    a = {(r.first_event_id, r.last_event_id, r.signal_type) for r in got.collect()}
    b = {(r.probe_event_id, r.large_event_id, "PROBE_THEN_LARGE") for r in probes.collect()}
    b |= {(r.first_event_id, r.success_event_id, "FAILED_THEN_SUCCESS") for r in failures.collect()}
    # events of one file may share times with those before them; the late ones of a later file never do here
    assert a == b and len(a) == got.count() and a


def test_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "sink")
    one = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, p string")
    two = spark.createDataFrame([("a", 3, "w")], "k string, v int, p string")
    for batch_id, df in [(0, one), (1, two), (1, two)]:
        write_batch(df, path, batch_id, ["k"], ["v"])
    expected = [("a", 3, "w"), ("b", 1, "z")]
    assert sorted(tuple(r) for r in read_latest(spark, path).collect()) == expected
    assert version(spark, path).number == 2  # the repeated batch made no version
    rebucket(spark, path, str(tmp_path / "small"), ["k"], 2)
    assert sorted(tuple(r) for r in read_latest(spark, str(tmp_path / "small")).collect()) == expected


def test_batches_of_a_stream_lie_on_the_table_until_they_are_as_large(spark, tmp_path, monkeypatch):
    """A batch of all buckets rewrites no part, its intermediate tables and the folders of old versions go, and the rows are
    the last ones of each key, whatever lies where."""
    monkeypatch.setattr(versioned, "FAN", 3, raising=False)
    monkeypatch.setattr(versioned, "SLICE", 1, raising=False)
    path, schema = str(tmp_path / "sink"), "k int, v int, p string"
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    left = set(shared.glob("upsert*"))
    expected, parts, rewritten, deep = {}, None, 0, 0

    def deliver(number, rows):
        write_batch(spark.createDataFrame(rows, schema).repartition(2), path, number, ["k"], ["v"], buckets=2)
        for k, v, p in rows:
            if k not in expected or v >= expected[k][0]:  # an equal one of a later batch counts
                expected[k] = (v, p)

    def found(rows):
        got = rows.collect()
        assert len(got) == len(expected)
        return {r.k: (r.v, r.p) for r in got}

    deliver(0, [(k, 5, sha256(str(k).encode()).hexdigest()) for k in [*range(2000), None]])
    for n in range(1, 12):
        # new keys, newer and late rows of known ones, rows as new as the stored ones
        deliver(n, [(2000 + n, n, f"new {n}"), (n, 9, f"newer {n}"), (n + 1, 4, "late"), (20, 5, f"equal {n}"), (30, n, f"rising {n}"), (None, 5, f"null {n}")])
        now = version(spark, path)
        rewritten += parts is not None and parts != now.parts
        parts, deep = now.parts, max([deep, *(r["level"] for r in now.runs)])
        assert len(now.runs) <= 3 * 2
    assert rewritten == 0 and deep == 2
    assert set(shared.glob("upsert*")) == left
    named = now.folders() | version(spark, path, now.number - 1).folders()
    assert {p.name for p in Path(path, "data").iterdir()} == named
    assert found(read_latest(spark, path)) == expected
    assert {r.k for p in parts for r in versioned.read_version(spark, path, parts=[p]).collect()} == set(expected)
    # rows in number make one table of parts and runs
    deliver(12, [(k, 6, sha256(f"again {k}".encode()).hexdigest()) for k in range(1000, 3500)])
    assert not version(spark, path).runs and found(read_latest(spark, path)) == expected


def test_runs_are_folded_and_give_way_to_other_changes(spark, tmp_path):
    path, schema = str(tmp_path / "sink"), "k int, v int, p string"
    base = spark.createDataFrame([(k, 5, sha256(str(k).encode()).hexdigest()) for k in range(2000)], schema)
    over = spark.createDataFrame([(k, 6, "over") for k in range(10)], schema)
    some = spark.createDataFrame([(1, 6, "same time"), (3, 5, "late"), (2001, 1, "new")], schema)
    write_batch(base, path, 0, ["k"], ["v"])
    write_batch(over, path, 1, ["k"], ["v"])
    with_run = version(spark, path)
    assert with_run.runs
    versioned.upsert(spark, path, some, ["k"], ["v"], removed=over.filter("k = 2"))
    rows = {r.k: r.p for r in read_latest(spark, path).collect()}
    assert len(rows) == 2000 and (rows[0], rows[1], rows[3], rows[2001]) == ("over", "same time", "over", "new") and 2 not in rows
    versioned.fold(spark, path)
    folded = version(spark, path)
    assert not folded.runs and {r.k: r.p for r in read_latest(spark, path).collect()} == rows
    versioned.fold(spark, path)  # nothing to do makes no version
    assert version(spark, path).number == folded.number
    # another column makes the table anew, as before
    write_batch(over.withColumn("v", F.lit(7).cast("long")), path, 2, ["k"], ["v"])
    assert read_latest(spark, path).filter("v = 7").count() == 10 and read_latest(spark, path).count() == 2001


def test_search_projection_leaves_only_topic_and_table(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    queries = load().queries
    rows = queries["stream_search_projection"](spark, "/root/testdata/sf0.001")
    made = sorted(p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before)
    assert made == ["decisions", "search", "search-checkpoint"]
    first = queries["decisions_idempotent"](spark, "/root/testdata/sf0.001")
    columns = ["decision_id", "txn_id", "account_token", "risk_level", "action", "cost_ms"]
    assert sorted(rows.select(columns).collect()) == sorted(first.withColumn("cost_ms", F.col("cost_ms") * 2).select(columns).collect())


def test_late_event_of_a_past_day_counts_for_devices_only(spark, txn, tmp_path):
    df = txn([("e-2", "a", "2026-07-22T01:00:00", 200, "x"), ("e-3", "a", "2026-07-21T23:58:00", 900, "y")])
    runtime.prepare_streaming(spark)
    folder = str(tmp_path / "in")
    stream = None
    for event in ("e-2", "e-3"):
        df.filter(F.col("event_id") == event).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).parquet(folder)
        out = runtime.run_to_table(sfeatures.stream_features(stream, ttl_days=None), str(tmp_path / "out"), str(tmp_path / "cp"))
    row = out.filter("event_id = 'e-3'").first()
    assert (str(row.daily_stat_date), row.daily_amount, row.daily_count, row.known_device_count, row.txn_count) == ("2026-07-22", 200, 1, 2, 1)


def test_sessions_merge_and_drop_what_is_late(spark, txn, tmp_path):
    """Sessions grow over micro-batches; an event behind the watermark counts only in a session that is still open."""
    rows = [("e-1", "a", "2026-07-22T01:00:00", 1), ("e-2", "a", "2026-07-22T01:30:00", 2), ("e-3", "a", "2026-07-22T02:00:01", 4),
            ("e-4", "b", "2026-07-22T02:10:00", 8), ("e-5", "b", "2026-07-22T02:05:00", 16), ("e-6", "a", "2026-07-22T00:00:00", 32),
            ("e-7", "b", "2026-07-22T09:00:00", 64), ("e-8", "b", "2026-07-22T19:00:00", 128)]
    df = txn(rows)
    runtime.prepare_streaming(spark)
    folder = str(tmp_path / "in")
    for event, *_ in rows:
        df.filter(F.col("event_id") == event).coalesce(1).write.mode("append").parquet(folder)
        stream = windows.session_totals(spark.readStream.schema(df.schema).parquet(folder))
        out = runtime.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.account_no, r.session_start.strftime("%H:%M:%S"), r.session_end.strftime("%H:%M:%S"), r.amount_minor) for r in out.collect())
    # just the gap apart is together, a second more is not; e-5 came late but into an open session; e-6 was dropped
    assert got == [("a", "01:00:00", "02:00:00", 3), ("a", "02:00:01", "02:30:01", 4), ("b", "02:05:00", "02:40:00", 24), ("b", "09:00:00", "09:30:00", 64)]


class Map(dict):
    """A map state without Spark."""

    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.get, dict.__setitem__, dict.pop


class Value:
    held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Handle:
    """The states of one account without Spark."""

    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Map())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Value())


@pytest.mark.parametrize("arrow_rows", [7, 10_000])
@pytest.mark.parametrize("batches", [1, 13])
def test_rows_in_memory_are_bounded(arrow_rows, batches):
    """Many rows of one account, dealt to one or many micro-batches and to small or large Arrow batches."""
    rnd = random.Random(batches)
    events = [(f"e{i:05d}", "a", *rest) for i, (_, _, *rest) in enumerate(random_events(13, n=4000, spread=900_000))]
    events += rnd.sample(events, 50)  # delivered twice
    window, chunk = timedelta(hours=30), 100
    expected = accumulate(sorted(events, key=lambda r: (r[2], r[0])), window)
    by_time = sorted(events, key=lambda r: r[2])
    times = sorted({r[2] for r in events})
    cuts = [times[len(times) * k // batches] for k in range(batches)] + [times[-1] + timedelta(1)]
    handle, got, peak = Handle(), {}, 0
    for low, high in zip(cuts, cuts[1:]):
        part = [r for r in by_time if low <= r[2] < high]
        rnd.shuffle(part)
        frame = pd.DataFrame(
            {
                "event_id": [r[0] for r in part],
                "amount_minor": [r[3] for r in part],
                "device_id": [r[4] for r in part],
                "counterparty": [r[5] for r in part],
                "event_us": [int(r[2].timestamp()) * 1_000_000 for r in part],
                "event_day": [r[2].toordinal() for r in part],
            }
        )
        processor = sfeatures.AccountFeatures(window, None, chunk)
        processor.init(handle)
        chunks = (frame.iloc[i : i + arrow_rows] for i in range(0, len(frame), arrow_rows))
        for out in processor.handleInputRows(("a",), chunks, None):
            assert len(out) <= 2 * chunk
            got |= {r.event_id: tuple(getattr(r, c) for c in COLUMNS) for r in out.itertuples()}
        peak = max(peak, processor.peak - min(arrow_rows, len(frame)))
        assert not handle.states["blocks"]  # nothing stays behind
    assert got == expected
    assert peak <= 2 * chunk  # beside the Arrow batch that is being read
    assert max(len(v[0]) // 8 for v in handle.states["times"].values()) <= chunk
