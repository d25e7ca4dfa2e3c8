"""Sequence patterns on golden cases and against a brute-force matcher."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from riskloom.functions.scan import by_weight, time_cuts
from riskloom.operators import patterns

T0 = datetime(2026, 7, 22, 1)


def at(seconds):
    return (T0 + timedelta(seconds=seconds)).isoformat()


def pairs(df):
    return sorted((r.probe_event_id, r.large_event_id) for r in df.collect())


def test_probe_then_large_window_is_strict(txn):
    rows = [("e1", "a", at(0), 10_000), ("e2", "a", at(60), 500), ("e3", "a", at(599), 1_000_000)]
    assert pairs(patterns.probe_then_large(txn(rows))) == [("e1", "e3"), ("e2", "e3")]
    rows[2] = ("e3", "a", at(600), 1_000_000)
    assert pairs(patterns.probe_then_large(txn(rows))) == [("e2", "e3")]


def statuses(txn, text, step=60):
    names = {"F": "FAILED", "S": "SUCCESS", "U": "UNKNOWN"}
    return txn([(f"e{i:03d}", "a", at(i * step), 1, None, None, names[s]) for i, s in enumerate(text)])


def matches(df, cuts=None):
    expanded = patterns.expand_matches(patterns.failed_then_success(df, cuts=cuts))
    return sorted((r.first_event_id, r.failure_count, r.success_event_id) for r in expanded.collect())


def test_every_sub_run_matches(txn):
    assert len(matches(statuses(txn, "FFFFS"))) == 3
    assert matches(statuses(txn, "FFUFS")) == []
    assert matches(statuses(txn, "FFFUS")) == [("e000", 3, "e004")]


def test_collapse_keeps_the_longest(txn):
    rows = patterns.failed_then_success(statuses(txn, "FFFFSFFFS"), collapse=True).collect()
    assert sorted((r.first_event_id, r.failure_count) for r in rows) == [("e000", 4), ("e005", 3)]


def brute_force(events, within):
    """All runs of at least three consecutive failures before the first later success, per account."""
    found = []
    for account in {e[1] for e in events}:
        own = [e for e in events if e[1] == account]
        for i, start in enumerate(own):
            for j in range(i + 2, len(own)):
                if any(e[3] != "FAILED" for e in own[i : j + 1]):
                    break
                later = [e for e in own[j + 1 :] if e[3] == "SUCCESS"]
                if later and later[0][2] - start[2] < within:
                    found.append((start[0], j - i + 1, later[0][0]))
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_failures_equal_brute_force(txn, seed):
    rnd = random.Random(seed)
    times = sorted(rnd.sample(range(0, 20_000), 160))
    events = [(f"e{i:03d}", rnd.choice("aab"), T0 + timedelta(seconds=s), rnd.choice(["FAILED"] * 5 + ["SUCCESS", "UNKNOWN"])) for i, s in enumerate(times)]
    df = txn([(e, a, t.isoformat(), 1, None, None, s) for e, a, t, s in events])
    for cuts in (None, time_cuts(df, "event_time", target_rows=4)):
        assert matches(df, cuts) == brute_force(events, timedelta(minutes=30))


@pytest.mark.parametrize("seed", [4, 5])
def test_probes_equal_brute_force(txn, seed):
    rnd = random.Random(seed)
    times = sorted(rnd.sample(range(0, 9_000), 150))
    events = [(f"e{i:03d}", rnd.choice("aab"), T0 + timedelta(seconds=s), rnd.choice([100, 10_000, 50_000, 1_000_000, 2_000_000])) for i, s in enumerate(times)]
    expected = []
    for i, (e, a, t, m) in enumerate(events):
        later = [x for x in events[i + 1 :] if x[1] == a and x[3] >= 1_000_000]
        if m <= 10_000 and later and later[0][2] - t < timedelta(minutes=10):
            expected.append((e, later[0][0]))
    df = txn([(e, a, t.isoformat(), m) for e, a, t, m in events])
    for cuts in (None, time_cuts(df, "event_time", target_rows=4)):
        assert pairs(patterns.probe_then_large(df, cuts=cuts)) == sorted(expected)


def test_signals_are_deterministic(txn):
    df = txn([("e1", "a", at(0), 10), ("e2", "a", at(60), 2_000_000)])
    runs = [
        patterns.signals(patterns.probe_then_large(df), patterns.run_evidence(patterns.failed_then_success(df), patterns.failed_then_success(df, 1))).collect()
        for _ in range(2)
    ]
    assert runs[0] == runs[1]
    (signal,) = runs[0]
    assert (signal.severity, signal.related_event_ids) == ("HIGH", ["e1", "e2"])
    assert signal.attributes == {"probeAmount": "10", "largeAmount": "2000000"}


def test_signal_names_every_failure_of_its_run(txn):
    kinds = ["FAILED", "FAILED", "UNKNOWN", "FAILED", "FAILED", "FAILED", "FAILED", "UNKNOWN", "SUCCESS", "FAILED"]
    df = txn([(f"e{i}", "a", at(10 * i), 1, None, None, k) for i, k in enumerate(kinds)])
    found = patterns.run_evidence(patterns.failed_then_success(df), patterns.failed_then_success(df, 1))
    assert {r.first_event_id: r.related_event_ids for r in found.collect()} == {
        "e3": ["e3", "e4", "e5", "e6", "e8"],
        "e4": ["e4", "e5", "e6", "e8"],
    }


@pytest.mark.parametrize("chunk", [2, 64])
def test_evidence_is_fetched_by_ranges_of_numbers(txn, chunk):
    rnd = random.Random(9)
    events = [(f"e{i:03d}", rnd.choice("aab"), T0 + timedelta(seconds=20 * i), rnd.choice(["FAILED"] * 6 + ["SUCCESS", "UNKNOWN"])) for i in range(150)]
    df = txn([(e, a, t.isoformat(), 1, None, None, s) for e, a, t, s in events])
    matches, every = patterns.failed_then_success(df), patterns.failed_then_success(df, 1)
    got = {r.first_event_id: r.related_event_ids for r in patterns.run_evidence(matches, every, chunk).collect()}
    expected = {}
    for first, length, success in brute_force(events, timedelta(minutes=30)):
        account = next(e[1] for e in events if e[0] == first)
        own = [e[0] for e in events if e[1] == account and e[0] >= first and e[3] == "FAILED"]
        if length >= len(expected.get(first, [])):
            expected[first] = [*own[:length], success]
    assert got == expected and got


def test_summary_needs_no_evidence(txn):
    df = statuses(txn, "FFFFSFFFS")
    probes, failures = patterns.probe_then_large(df), patterns.failed_then_success(df)
    daily = patterns.signal_summary(patterns.detections(probes, failures))
    full = patterns.signal_summary(patterns.signals(probes, patterns.run_evidence(failures, patterns.failed_then_success(df, 1))))
    assert daily.collect() == full.collect() and daily.first().signals == 3
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_heavy_accounts_alone_are_cut(txn):
    rnd = random.Random(10)
    events = [(f"e{i:03d}", rnd.choice("aaab"), T0 + timedelta(seconds=30 * i), rnd.choice(["FAILED"] * 4 + ["SUCCESS"])) for i in range(120)]
    df = txn([(e, a, t.isoformat(), 1, None, None, s) for e, a, t, s in events])
    seen = []

    def scan(rows, cuts):
        seen.append((sorted({r.account_no for r in rows.select("account_no").collect()}), len(cuts)))
        return patterns.failed_then_success(rows, cuts=cuts)

    found = by_weight(df, "account_no", "event_time", scan, target_rows=55)
    got = sorted((r.first_event_id, r.failure_count, r.success_event_id) for r in patterns.expand_matches(found).collect())
    assert got == brute_force(events, timedelta(minutes=30))
    assert seen[0] == (["b"], 0) and seen[1][0] == ["a"] and seen[1][1] > 0
