"""Tags, account groups and skew-safe joins."""

from __future__ import annotations

import math
import random
from datetime import timedelta

from pyspark.sql import functions as F

from riskloom import session
from riskloom.functions.joins import salted_join
from riskloom.functions.scan import time_cuts, value_ranges
from riskloom.operators import graph, tags


def edges_txn(spark, pairs):
    return spark.createDataFrame(pairs, "account_no string, device_id string")


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, d in pairs:
        parent[find("a" + a)] = find("d" + d)
    groups = {}
    for a, _ in pairs:
        groups.setdefault(find("a" + a), set()).add(a)
    return {a: min(g) for g in groups.values() for a in g}


def test_groups_of_a_long_chain_and_a_star(spark):
    chain = [(f"c{i:02d}", f"x{i}") for i in range(20)] + [(f"c{i + 1:02d}", f"x{i}") for i in range(20)]
    star = [(f"s{i:02d}", "hub") for i in range(40)]
    out = {r.account_no: r.group_id for r in graph.shared_device_groups(edges_txn(spark, chain + star)).collect()}
    assert out == components(chain + star)


def test_groups_of_random_edges(spark):
    rnd = random.Random(5)
    pairs = [(f"a{rnd.randrange(60):02d}", f"d{rnd.randrange(50)}") for _ in range(70)]
    out = {r.account_no: r.group_id for r in graph.shared_device_groups(edges_txn(spark, pairs)).collect()}
    assert out == components(pairs)


def test_contraction_shrinks_and_takes_few_rounds(spark):
    """A chain of 3,000 nodes and a star: rounds follow the logarithm, edges fall in every round, no table stays but the result."""
    chain = [(i, i + 1) for i in range(3000)]
    star = [(10_000, 20_000 + i) for i in range(500)]
    before = len(session._MADE)
    edges = spark.createDataFrame(chain + star, "u long, v long")
    spread = edges.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))
    found = graph.contract(spread)
    sizes = [r["n"] for r in found.roots.groupBy("root").agg(F.count("*").alias("n")).collect()]
    assert sorted(sizes) == [501, 3001]
    assert len(found.edges) <= 2 * math.log2(3000) and found.edges[-1] == 0
    assert all(b < a for a, b in zip(found.edges, found.edges[1:]))
    assert len(session._MADE) - before == 1
    assert graph.contract(spread.limit(0)).roots.count() == 0


def test_hops_from_seeds(spark):
    pairs = [("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("c", "3"), ("d", "3"), ("e", "9")]
    edges = graph.device_edges(edges_txn(spark, pairs))
    seeds = spark.createDataFrame([("a",)], "account_no string")
    assert {r.account_no: r.hops for r in graph.linked_within(edges, seeds, 2).collect()} == {"b": 1, "c": 2}


def test_fund_roles(spark):
    rows = [("a", f"p{i}") for i in range(3)] + [(f"q{i}", "a") for i in range(3)]
    df = spark.createDataFrame(rows, "account_no string, counterparty string")
    roles = {r.account: r.fund_role for r in graph.fund_role(df, hub=3, relay=3).collect()}
    assert roles["a"] == "RELAY" and roles["p0"] == "ORDINARY"


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "k string, v int")
    for target in (10, 100, 1000):  # many salts, two, none
        for how in ("inner", "left", "left_semi", "left_anti"):
            a = salted_join(left, right, ["k"], ["id"], how, target_rows=target).collect()
            assert sorted(map(tuple, a), key=str) == sorted(map(tuple, left.join(right, "k", how).select(*a[0].asDict()).collect()), key=str)
    salted = salted_join(left, right, ["k"], ["id"], target_rows=10)._jdf.queryExecution().analyzed().toString()
    assert "_salt" in salted and "_salt" not in salted_join(left, right, ["k"], ["id"])._jdf.queryExecution().analyzed().toString()


def test_twice_the_rows_give_twice_the_chunks(spark):
    df = spark.range(400).selectExpr("timestamp_seconds(id) AS t", "id / 3 AS v")
    for rows in (100, 200, 400):
        part = df.filter(f"unix_seconds(t) < {rows}")
        assert len(time_cuts(part, "t", target_rows=50)) + 1 == rows // 50
        assert value_ranges(part, "v", "r", target_rows=50).select("r").distinct().count() == rows // 50
    assert time_cuts(df, "t") == []


def test_fast_in_out(spark):
    rows = [("a", "2026-07-22 10:00:00", "e1", 100), ("a", "2026-07-22 10:20:00", "e2", -30), ("a", "2026-07-22 11:00:00", "e3", -10), ("b", "2026-07-22 10:00:00", "e1", -5)]
    df = spark.createDataFrame(rows, "account string, event_time string, event_id string, signed_amount bigint").withColumn("event_time", F.col("event_time").cast("timestamp"))
    out = {r.account: r.fast_in_out_ratio for r in tags.fast_in_out(df, within=timedelta(minutes=30)).collect()}
    assert out == {"a": 0.75, "b": 0.0}


def test_top_category_ties_go_to_text_order(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "w"), ("b", "x")], "k string, c string")
    assert {r.k: r.top_c for r in tags.top_categories(df, "k", ["c"]).collect()} == {"a": "w", "b": "x"}


def test_network_change(txn):
    df = txn([("e1", "a", "2026-07-22T01:00:00", 1), ("e2", "a", "2026-07-22T09:00:00", 1), ("e3", "a", "2026-07-23T01:00:00", 1)])
    df = df.withColumn("ip", F.when(F.col("event_id") == "e2", "11.1.0.1").otherwise("10.0.0.1"))
    assert {r.event_id: r.geo_anomaly for r in tags.network_change(df, "account_no").collect()} == {"e1": False, "e2": True, "e3": True}


def test_z_scores_fill_and_clip(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(30)] + [(30, 1000.0), (31, None)], "k int, x double")
    out = {r.k: r for r in tags.z_scores(df, "k", "x").collect()}
    assert out[30].z_score == 3.0 and out[31].z_score == 0.0
