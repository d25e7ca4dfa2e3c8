"""Profiles, merges and rating on golden cases."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.operators import facts as fact_ops
from riskloom.operators import ingestion, profile, rating
from riskloom.sources import versioned
from riskloom.sources.versioned import read_version, version


def ts(text):
    return F.lit(text).cast("timestamp")


FACTS = "source_id string, txn_id string, customer_id string, counterparty_id string, amount_minor bigint, event_time string"
LABELS = "source_id string, txn_id string, label string, created_at string"


@pytest.fixture
def frames(spark):
    def make(facts, labels):
        f = spark.createDataFrame(facts, FACTS).withColumn("event_time", F.col("event_time").cast("timestamp"))
        return f, spark.createDataFrame(labels, LABELS).withColumn("created_at", F.col("created_at").cast("timestamp"))

    return make


GOLDEN_FACTS = [
    ("s", "t1", "cust-1", "cp-1", 100, "2026-07-22 01:00:00"),
    ("s", "t2", "cust-1", "cp-2", 200, "2026-07-21 12:00:00"),
]
GOLDEN_LABELS = [("s", "t1", "FRAUD", "2026-07-22 02:00:00"), ("s", "t2", "NORMAL", "2026-07-21 13:00:00")]


@pytest.mark.parametrize("exact", [True, False])
def test_golden_profile(frames, exact):
    f, lab = frames(GOLDEN_FACTS, GOLDEN_LABELS)
    (row,) = profile.profile_90d(f, lab, ts("2026-07-21"), ts("2026-07-22 12:00:00"), exact=exact).collect()
    assert (row.amount_90d, row.txn_cnt_90d, row.unique_counterparty_90d, row.night_ratio, row.fraud_count_90d) == (300, 2, 2, 0.5, 1)
    assert row.profile_as_of == datetime(2026, 7, 22, 1)


def test_exact_profile_ignores_blank_counterparties(frames):
    f, lab = frames([*GOLDEN_FACTS, ("s", "t3", "cust-1", " ", 1, "2026-07-20 12:00:00")], GOLDEN_LABELS)
    row = profile.profile_90d_exact(f, lab, ts("2026-07-22 12:00:00")).first()
    assert (row.unique_counterparty_90d, row.txn_cnt_90d, row.recency_days) == (2, 3, 0)


def test_customer_leaving_the_window_is_reset(frames):
    f, lab = frames([("s", "t1", "gone", "c", 5, "2026-04-22 12:00:00"), ("s", "t2", "calm", "c", 5, "2026-06-01 00:00:00")], [])
    rows = profile.profile_90d(f, lab, ts("2026-07-21"), ts("2026-07-22 12:00:00")).collect()
    assert [(r.customer_id, r.amount_90d, r.recency_days) for r in rows] == [("gone", 0, 91)]


def test_window_ends_are_included_by_second(frames):
    rows = [("s", str(i), "c", None, 1, t) for i, t in enumerate(["2026-04-23 12:00:00", "2026-04-23 11:59:59", "2026-07-22 12:00:00.9", "2026-07-22 12:00:01"])]
    f, _ = frames(rows, [])
    assert sorted(r.txn_id for r in profile.window_facts(f, ts("2026-07-22 12:00:00")).collect()) == ["0", "2"]


def test_new_label_affects_its_customer(frames):
    f, lab = frames([("s", "t1", "old", "c", 5, "2026-06-01 00:00:00")], [("s", "t1", "FRAUD", "2026-07-21 10:00:00")])
    row = profile.profile_90d(f, lab, ts("2026-07-21"), ts("2026-07-22")).first()
    assert (row.customer_id, row.fraud_count_90d) == ("old", 1)


def test_incremental_equals_full(frames):
    facts = [("s", str(i), f"c{i % 7}", f"p{i % 3}", i, f"2026-0{3 + i % 5}-{1 + i % 28:02d} 0{i % 9}:00:00") for i in range(120)]
    labels = [("s", str(i), "FRAUD" if i % 3 else "NORMAL", "2026-07-25 00:00:00") for i in range(0, 120, 10)]
    f, lab = frames(facts, labels)
    row = profile.incremental_parity(f, lab, ts("2026-07-10"), ts("2026-07-28")).first()
    assert (row.only_incremental, row.only_full) == (0, 0) and row.customers == 7


@pytest.mark.parametrize("as_of", ["2026-07-28 00:00:00", "2026-07-28 13:45:10"])
def test_partials_give_the_same_profiles(spark, frames, tmp_path, as_of):
    facts = [
        ("s", str(i), f"c{i % 7}", None if i % 11 == 0 else f"p{i % 5}", i, f"2026-0{4 + i % 4}-{1 + i % 28:02d} {i % 24:02d}:{i % 60:02d}:10")
        for i in range(300)
    ]
    labels = [("s", str(i), "FRAUD" if i % 3 else "NORMAL", "2026-07-25 00:00:00") for i in range(0, 300, 10)]
    f, lab = frames(facts, labels)
    path = str(tmp_path / "p")
    # the last month arrives in two deliveries, the second one whole
    profile.write_partials(spark, path, f.filter("event_time < '2026-07-10'"))
    profile.write_partials(spark, path, f.filter("event_time >= '2026-07-01'"))
    got = profile.profile_90d_partials(spark, path, f, lab, ts("2026-07-10"), ts(as_of), "Asia/Shanghai")
    exact = profile.profile_90d(f, lab, ts("2026-07-10"), ts(as_of), "Asia/Shanghai", exact=True)
    # nights follow the zone that the partials were made with
    columns = [c for c in exact.columns if c != "night_ratio"]
    assert sorted(got.select(*columns).collect()) == sorted(exact.select(*columns).collect())
    same = profile.profile_90d_partials(spark, path, f, lab, ts("2026-07-10"), ts(as_of))
    utc = profile.profile_90d(f, lab, ts("2026-07-10"), ts(as_of), exact=True)
    assert sorted(same.collect()) == sorted(utc.collect())


def test_profile_reads_the_facts_of_affected_customers(frames):
    f, lab = frames([("s", "1", "c1", "p", 5, "2026-07-20 00:00:00")], [("s", "1", "FRAUD", "2026-07-25 00:00:00")])
    plan = profile.profile_90d(f, lab, ts("2026-07-10"), ts("2026-07-28"))._jdf.queryExecution().optimizedPlan().toString()
    aggregates = plan.index("Aggregate [customer_id")
    assert "LeftSemi" in plan[aggregates:]


def test_job_from_increment_to_documents(spark, frames, tmp_path, monkeypatch):
    """Late and corrected facts, a run that stops in the middle, and a repeated run end in the profiles of a full computation."""
    facts = [("s", str(i), f"c{i % 5}", f"p{i % 3}", 10 * i, f"2026-0{5 + i % 3}-{1 + i % 28:02d} 0{i % 9}:30:00") for i in range(90)]
    labels = [("s", str(i), "FRAUD", "2026-07-25 00:00:00") for i in range(0, 90, 9)]
    moved = [("s", "5", "c0", "p2", 7, "2026-07-30 09:00:00"), ("s", "200", "c9", "p9", 1, "2026-07-29 10:00:00"), ("s", "201", "c1", "p9", 2, "2026-05-02 10:00:00")]
    f, lab = frames(facts, labels)
    new, _ = frames(moved, labels)
    store = ingestion.Store(str(tmp_path))
    ingestion.ingest(spark, store, f, lab, ts("1970-01-01"), ts("2026-07-28 12:00:00"))
    late = ts("2026-07-31 12:00:00")
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(ingestion, "profile_90d_partials", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
        ingestion.ingest(spark, store, new, lab, ts("2026-04-01"), late)
    everything, _ = frames([x for x in facts if x[1] != "5"] + moved, labels)
    for _ in range(2):
        ingestion.ingest(spark, store, new, lab, ts("2026-04-01"), late)
        full = profile.profile_90d(everything, lab, ts("1970-01-01"), late, exact=True)
        assert sorted(read_version(spark, store.profiles).select(*full.columns).collect()) == sorted(full.collect())
        documents = {r.doc_id: json.loads(r.document) for r in read_version(spark, store.documents).collect()}
        assert {c: d["amount_90d"] for c, d in documents.items()} == {r.customer_id: r.amount_90d for r in full.collect()}
    # a fact that moved has left its old day's partials
    assert read_version(spark, store.partials).agg(F.sum("txns")).first()[0] == 92


def test_merge_replaces_by_key(spark):
    a = spark.createDataFrame([("s", "1", 1), ("s", "2", 2)], "source_id string, txn_id string, v int")
    b = spark.createDataFrame([("s", "2", 9), ("s", "3", 3)], "source_id string, txn_id string, v int")
    assert sorted(r.v for r in fact_ops.merge_replace(a, b, fact_ops.KEYS).collect()) == [1, 3, 9]


FACT = "source_id string, txn_id string, v int, day string"


def stored(spark, target):
    return sorted((r.txn_id, r.v, r.day) for r in read_version(spark, target).collect())


def test_write_merged_touches_only_named_partitions(spark, tmp_path):
    target = str(tmp_path / "t")
    first = spark.createDataFrame([("s", "1", 1, "d1"), ("s", "2", 2, "d2")], FACT)
    fact_ops.write_merged(spark, target, first, fact_ops.KEYS, "day")
    untouched = version(spark, target).parts["pd1"]
    second = spark.createDataFrame([("s", "2", 5, "d2"), ("s", "3", 3, "d2")], FACT)
    fact_ops.write_merged(spark, target, second, fact_ops.KEYS, "day")
    assert [v for _, v, _ in stored(spark, target)] == [1, 5, 3]
    assert version(spark, target).parts["pd1"] == untouched
    # a key that moves leaves its old partition, also when that empties it
    moved = spark.createDataFrame([("s", "1", 7, "d2"), ("s", "4", 4, "d3")], FACT)
    fact_ops.write_merged(spark, target, moved, fact_ops.KEYS, "day")
    assert stored(spark, target) == [("1", 7, "d2"), ("2", 5, "d2"), ("3", 3, "d2"), ("4", 4, "d3")]
    assert set(version(spark, target).parts) == {"pd2", "pd3"}


def test_merge_reads_only_touched_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("s", str(i), i, f"d{i % 5}") for i in range(20)], FACT)
    target = str(tmp_path / "t")
    fact_ops.write_merged(spark, target, rows, fact_ops.KEYS, "day")
    assert len(read_version(spark, target).inputFiles()) == 5  # one file per partition
    some = read_version(spark, target, parts=["pd1", "pd2", "absent"])
    assert len(some.inputFiles()) == 2 and sorted({r.day for r in some.collect()}) == ["d1", "d2"]


def test_merge_keeps_null_and_odd_partitions(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = [("s", "1", 1, None), ("s", "2", 2, None), ("s", "3", 3, ""), ("s", "4", 4, "a/b=c %*+~"), ("s", "5", 5, "null")]
    fact_ops.write_merged(spark, target, spark.createDataFrame(rows, FACT), fact_ops.KEYS, "day")
    again = [("s", "6", 6, None), ("s", "2", 22, None), ("s", "4", 44, "a/b=c %*+~")]
    fact_ops.write_merged(spark, target, spark.createDataFrame(again, FACT), fact_ops.KEYS, "day")
    assert stored(spark, target) == [
        ("1", 1, None), ("2", 22, None), ("3", 3, ""), ("4", 44, "a/b=c %*+~"), ("5", 5, "null"), ("6", 6, None),
    ]
    assert len(version(spark, target).parts) == 4


@pytest.mark.parametrize("step", ["_names", "_commit"])
def test_merge_that_stops_between_its_writes_changes_nothing(spark, tmp_path, monkeypatch, step):
    target = str(tmp_path / "t")
    rows = spark.createDataFrame([("s", str(i), i, f"d{i % 3}") for i in range(9)], FACT)
    fact_ops.write_merged(spark, target, rows, fact_ops.KEYS, "day")
    before = stored(spark, target)
    moved = spark.createDataFrame([("s", "0", 100, "d1"), ("s", "50", 50, "d9")], FACT)

    def fail(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m, pytest.raises(OSError):
        # after the new folders are written, or just before the new version appears; the table's own version is read as ever
        newest = version(spark, target)
        m.setattr(fact_ops, "version", lambda *_: newest)
        m.setattr(versioned, step, fail)
        fact_ops.write_merged(spark, target, moved, fact_ops.KEYS, "day")
    assert stored(spark, target) == before
    fact_ops.write_merged(spark, target, moved, fact_ops.KEYS, "day")
    assert sorted([*before[1:], ("0", 100, "d1"), ("50", 50, "d9")]) == stored(spark, target)
    # what the failed merge left is deleted with the versions that are no longer kept
    rows_before = stored(spark, target)
    assert versioned.vacuum(spark, target, keep=1) >= 2 and stored(spark, target) == rows_before
    assert len(list((tmp_path / "t" / "data").iterdir())) <= 2


def test_second_writer_of_a_version_fails(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = spark.createDataFrame([("s", "1", 1, "d1")], FACT).withColumn("_part", F.lit("pd1"))
    base = version(spark, target)
    versioned.replace_parts(rows, target, base, ["pd1"])
    with pytest.raises(versioned.ConflictError):
        versioned.replace_parts(rows.withColumn("v", F.lit(2)), target, base, ["pd1"])
    assert stored(spark, target) == [("1", 1, "d1")]


def test_keyed_table_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, 1, f"v{i}") for i in range(200)] + [(None, 1, "null key")], "k int, t int, v string")
    versioned.upsert(spark, path, rows, ["k"], ["t"], buckets=8)
    first = version(spark, path)
    late = spark.createDataFrame([(7, 0, "late"), (8, 2, "new"), (9, 1, "same time")], "k int, t int, v string")
    versioned.upsert(spark, path, late, ["k"], ["t"])
    second = version(spark, path)
    changed = [p for p in second.parts if second.parts[p] != first.parts[p]]
    assert 1 <= len(changed) <= 3 and second.buckets == 8
    found = {r.k: r.v for r in read_version(spark, path).collect()}
    assert len(found) == 201 and (found[7], found[8], found[9], found[None]) == ("v7", "new", "same time", "null key")
    # keys can go, and a table can be dealt anew
    versioned.upsert(spark, path, late.limit(0), ["k"], ["t"], removed=late)
    assert read_version(spark, path).count() == 198
    versioned.rebucket(spark, path, str(tmp_path / "u"), ["k"], 3)
    assert read_version(spark, str(tmp_path / "u")).count() == 198 and len(version(spark, str(tmp_path / "u")).parts) == 3
    # an earlier version can still be read
    assert read_version(spark, path, first).count() == 201


def test_profile_merge_drops_customers_without_profile(spark, tmp_path):
    path, schema = str(tmp_path / "p"), "customer_id string, amount_90d bigint, profile_as_of timestamp"
    at = datetime(2026, 7, 1)
    profile.write_profiles(spark, path, spark.createDataFrame([(f"c{i}", i, at) for i in range(5)], schema))
    updates = spark.createDataFrame([("c1", 100, at)], schema)
    affected = spark.createDataFrame([("c1",), ("c2",)], "customer_id string")
    for _ in range(2):  # merging again changes nothing
        profile.write_profiles(spark, path, updates, affected)
        got = {r.customer_id: r.amount_90d for r in read_version(spark, path).collect()}
        assert got == {"c0": 0, "c1": 100, "c3": 3, "c4": 4}


CUSTOMERS = [("C001", 5_000_000, 350, 80, 500.0, 0.7), ("C002", 1_200_000, 60, 10, 8_000.0, 0.2), ("C003", 30_000, 5, 2, 50_000.0, 0.05)]


def test_golden_ratings(spark):
    df = spark.createDataFrame(CUSTOMERS, "cust_id string, amount_90d bigint, txn_cnt_90d bigint, counterparty bigint, avg_balance double, night_ratio double")
    rows = {r.cust_id: r for r in rating.grade(rating.score(df)).collect()}
    assert [(rows[c].total_score, rows[c].grade) for c in ("C001", "C002", "C003")] == [(100, "D"), (30, "B"), (0, "A")]
    assert len(rows["C001"].hit_rules) == 5 and rows["C002"].hit_rules == ["HIGH_AMOUNT_90D"]


def test_unknown_operator_null_tag_and_disabled_rule_do_not_hit(spark):
    df = spark.createDataFrame([("C", 5, None)], "cust_id string, a bigint, b bigint")
    rules = [
        rating.ScoreRule("M", "NE", "a", "NE", 1, 10), rating.ScoreRule("M", "NULL", "b", "LT", 1, 10),
        rating.ScoreRule("M", "OFF", "a", "GT", 1, 10, enabled=False), rating.ScoreRule("OTHER", "X", "a", "GT", 1, 10),
        rating.ScoreRule("M", "ABSENT", "zzz", "GT", 1, 10), rating.ScoreRule("M", "GE", "a", "GE", 5, 7),
    ]
    row = rating.score(df, rules, "M").first()
    assert (row.total_score, row.hit_rules) == (7, ["GE"])


def test_rating_input_prefixes_shared_columns(spark):
    wide = spark.createDataFrame([("C", 1, 2)], "cust_id string, x int, y int")
    tags = spark.createDataFrame([("C", 9)], "cust_id string, x int")
    row = rating.rating_input(wide, tags).first()
    assert (row.wide_x, row.x, row.y) == (1, 9, 2)


def test_numeric_tags_drop_text(spark):
    df = spark.createDataFrame([("C", 1, "t", None)], "cust_id string, a int, b string, c double")
    assert [(r.field, r.value) for r in rating.tags_long(df).collect()] == [("a", 1.0)]
