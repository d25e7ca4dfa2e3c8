"""Account features against the state rules, on golden cases and random events."""

from __future__ import annotations

import re
import random
from datetime import datetime, timedelta

import pytest

from riskloom.functions.scan import time_cuts
from riskloom.operators import features


def accumulate(events, window=timedelta(minutes=5)):
    """Plain statement of the rules for events of any accounts, in order; one result per new event id."""
    state, out, seen = {}, {}, set()
    for event_id, account, t, amount, device, party in events:
        if event_id in seen:
            continue
        seen.add(event_id)
        s = state.setdefault(account, {"day": None, "amount": 0, "count": 0, "max": t, "recent": [], "dev": set(), "cp": set()})
        if s["day"] is None or t.date() > s["day"]:
            s.update(day=t.date(), amount=0, count=0)
        if t.date() == s["day"]:
            s["amount"] += amount
            s["count"] += 1
        s["max"] = max(s["max"], t)
        s["recent"] = [x for x in [*s["recent"], t] if x >= s["max"] - window]
        new = bool(device and device.strip()) and device not in s["dev"]
        if new:
            s["dev"].add(device)
        if party and party.strip():
            s["cp"].add(party)
        out[event_id] = (s["amount"], s["count"], len(s["recent"]), new, len(s["dev"]), len(s["cp"]))
    return out


COLUMNS = ["daily_amount", "daily_count", "txn_count", "device_new", "known_device_count", "unique_counterparty_count"]


def snapshot_of(df, **kw):
    return {r["event_id"]: tuple(r[c] for c in COLUMNS) for r in features.feature_snapshot(df, **kw).collect()}


def test_duplicate_counts_once(txn):
    df = features.dedupe_events(txn([("e-1", "a", "2026-07-21T23:59:00", 100, "d-1")] * 2))
    row = features.feature_snapshot(df).first()
    assert (str(row.daily_stat_date), row.txn_count, row.daily_amount, row.daily_count) == ("2026-07-21", 1, 100, 1)


def test_two_devices_and_parties(txn):
    df = txn([("e-1", "a", "2026-07-22T01:00:00", 100, "device-a", "c-a"), ("e-2", "a", "2026-07-22T01:02:00", 200, "device-a", "c-b")])
    assert snapshot_of(df) == {"e-1": (100, 1, 1, True, 1, 1), "e-2": (300, 2, 2, False, 1, 2)}


def test_velocity_lower_bound_is_inclusive(txn):
    df = txn([("e-1", "a", "2026-07-22T01:00:00", 1), ("e-2", "a", "2026-07-22T01:05:00", 1), ("e-3", "a", "2026-07-22T01:05:00.000001", 1)])
    assert [r.txn_count for r in features.velocity(df).orderBy("event_id").collect()] == [1, 2, 2]


def test_day_follows_the_zone(txn):
    df = txn([("e-1", "a", "2026-07-22T15:30:00", 1), ("e-2", "a", "2026-07-22T16:30:00", 2)])
    rows = features.daily_running(df, zone="Asia/Shanghai").orderBy("event_id").collect()
    assert [r.daily_amount for r in rows] == [1, 2]
    assert [r.daily_amount for r in features.daily_running(df).orderBy("event_id").collect()] == [1, 3]


def random_events(seed, n=250, accounts=3, spread=200_000):
    rnd = random.Random(seed)
    start = datetime(2026, 7, 20, 22)
    rows = []
    for i in range(n):
        # one account holds most of the rows, and some times collide
        account = "hot" if rnd.random() < 0.6 else f"a{rnd.randrange(accounts)}"
        t = start + timedelta(seconds=rnd.randrange(0, spread, 60))
        rows.append((f"e{i:04d}", account, t, rnd.randrange(1, 100), rnd.choice([None, " ", "x", "y", "z"]), rnd.choice([None, "", "p", "q", "r"])))
    return sorted(rows, key=lambda r: (r[2], r[0]))


@pytest.mark.parametrize("seed,ranges", [(1, None), (2, 3), (3, 50)])
def test_snapshot_equals_state_rules(txn, seed, ranges):
    events = random_events(seed)
    df = txn([(e, a, t.isoformat(), m, d, c) for e, a, t, m, d, c in events])
    window = timedelta(minutes=47)
    cuts = time_cuts(df, "event_time", target_rows=max(1, len(events) // ranges)) if ranges else None
    assert snapshot_of(df, window=window, cuts=cuts) == accumulate(events, window)


def test_single_features_equal_snapshot(txn):
    events = random_events(7)
    df = txn([(e, a, t.isoformat(), m, d, c) for e, a, t, m, d, c in events])
    expected = accumulate(events)
    for op, position in [
        (features.velocity(df), {"txn_count": 2}),
        (features.daily_running(df), {"daily_amount": 0, "daily_count": 1}),
        (features.device_new(df), {"device_new": 3}),
        (features.distinct_running(df, "device_id", "n"), {"n": 4}),
        (features.distinct_running(df, "counterparty", "n"), {"n": 5}),
    ]:
        for row in op.collect():
            for column, index in position.items():
                assert row[column] == expected[row.event_id][index]


def test_features_as_of_are_those_of_the_previous_event(txn):
    df = txn([("e-1", "a", "2026-07-21T10:00:00", 5, "x"), ("e-2", "a", "2026-07-22T12:00:00", 7, "x"), ("e-3", "a", "2026-07-22T12:01:00", 1, "x")])
    as_of = features.features_as_of(features.feature_snapshot(df))
    rows = {r.event_id: r for r in as_of.collect()}
    assert rows["e-1"].daily_amount is None
    assert (rows["e-2"].daily_amount, rows["e-2"].device_new) == (5, True)  # yesterday's stored values
    assert (rows["e-3"].daily_amount, rows["e-3"].daily_count) == (7, 1)
    fresh = {r.event_id: r.daily_amount for r in features.refreshed(as_of).collect()}
    assert fresh == {"e-1": 0, "e-2": 0, "e-3": 7}


def test_parity_check_counts_differences(spark):
    a = spark.createDataFrame([("e1", 1), ("e2", 2), ("e3", 3)], "event_id string, v int")
    b = spark.createDataFrame([("e1", 1), ("e2", 9)], "event_id string, v int")
    row = features.parity_check(a, b).first()
    assert (row.events, row.one_sided, row.mismatch_v) == (3, 1, 2)


def test_latest_keeps_last_event(txn):
    df = txn([("e-1", "a", "2026-07-21T10:00:00", 5), ("e-2", "a", "2026-07-22T12:00:00", 7)])
    assert [r.daily_amount for r in features.latest_features(features.feature_snapshot(df)).collect()] == [7]


def test_model_features_use_major_units(txn):
    df = txn([("e-1", "a", "2026-07-21T10:00:00", 500, "x", "p")])
    row = features.model_features(features.features_as_of(features.feature_snapshot(df))).first()
    assert (row.amount, row.daily_amount, row.hour, row.cross_bank, row.device_new) == (5.0, 0.0, 10.0, 1.0, 0.0)


def plan_lines(frame):
    return frame._jdf.queryExecution().executedPlan().toString().splitlines()


def hash_shuffles(frame):
    """The shuffles by key of the initial plan, each with the operator that feeds it."""
    lines = plan_lines(frame)
    return [(line, below) for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning(" in line]


def test_accounts_of_usual_size_take_one_shuffle(txn):
    frame = features.features_before(txn([("e-1", "a", "2026-07-21T10:00:00", 500, "x", "p")]))
    shuffles = hash_shuffles(frame)
    assert len(shuffles) == 1 and re.search(r"hashpartitioning\(account_no#\d+, \d+\)", shuffles[0][0])
    assert not any("SortAggregate" in line for line in plan_lines(frame))


def test_hot_account_is_cut_into_ranges(txn):
    """Rows of a heavy account are dealt by account, day and range; by account alone only the sums of ranges meet."""
    events = random_events(11)
    df = txn([(e, a, t.isoformat(), m, d, c) for e, a, t, m, d, c in events])
    frame = features.feature_snapshot(df, target_rows=60)
    shuffles = hash_shuffles(frame)
    assert any("_day" in line and "_slot" in line for line, _ in shuffles)
    alone = [below for line, below in shuffles if re.search(r"hashpartitioning\(account_no#\d+, \d+\)", line)]
    lines = "\n".join(plan_lines(frame))
    light = [below for below in alone if "Aggregate" not in below]
    assert len(light) == 1 and re.search(r"Filter .*NOT .*account_no#\d+ *(=|IN).*hot", lines)  # the others alone


@pytest.mark.parametrize("seed,target_rows", [(4, 10_000), (5, 60), (6, 7)])
def test_values_before_equal_stored_snapshots(txn, seed, target_rows):
    events = random_events(seed)
    df = txn([(e, a, t.isoformat(), m, d, c) for e, a, t, m, d, c in events])
    window = timedelta(minutes=47)
    snapshot = features.feature_snapshot(df, window=window, target_rows=target_rows)
    assert {r["event_id"]: tuple(r[c] for c in COLUMNS) for r in snapshot.collect()} == accumulate(events, window)
    stored = features.features_as_of(features.feature_snapshot(df, window=window), [])
    before = features.features_before(df, window=window, target_rows=target_rows)
    assert before.columns == stored.columns
    assert sorted(before.collect(), key=repr) == sorted(stored.collect(), key=repr)


def test_velocity_of_hot_accounts(txn):
    events = random_events(8)
    df = txn([(e, a, t.isoformat(), m, d, c) for e, a, t, m, d, c in events])
    for target_rows in (10_000, 50):
        expected = accumulate(events)
        got = features.velocity(df, target_rows=target_rows).collect()
        assert {r.event_id: r.txn_count for r in got} == {e: v[2] for e, v in expected.items()}


def test_decisions_read_the_events_once(spark):
    import __spark_entry__ as entry

    frame = entry.queries()["decisions"](spark, "/root/testdata/sf0.001")
    scans = [line for line in plan_lines(frame) if "FileScan" in line or "Scan parquet" in line]
    assert len(scans) <= 4 and len(hash_shuffles(frame)) <= 5
    assert (len(scans), len(hash_shuffles(frame))) == (1, 1)
