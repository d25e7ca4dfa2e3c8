"""Change records, retention, daily files and projections."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from riskloom.operators import privacy
from riskloom.sources.changes import current_state, increment, retained, retention_tier
from riskloom.sources.sinks import json_documents, write_daily_partitions


def test_current_state_keeps_deletes_as_flag(spark):
    row = "struct<id:int,v:string>"
    schema = f"before {row}, after {row}, op string, source struct<table:string,ts_ms:bigint,pos:bigint>"
    changes = [
        (None, (1, "a"), "c", ("t", 10, 1)),
        ((1, "a"), (1, "b"), "u", ("t", 20, 2)),
        (None, (2, "x"), "c", ("t", 10, 3)),
        ((2, "x"), None, "d", ("t", 10, 4)),
    ]
    rows = {r.id: r for r in current_state(spark.createDataFrame(changes, schema), ["id"]).collect()}
    assert (rows[1].v, rows[1]["__deleted"]) == ("b", False)
    assert (rows[2].v, rows[2]["__deleted"], rows[2]["__op"]) == ("x", True, "d")


def aged(spark):
    df = spark.createDataFrame([("a", "2026-07-20"), ("b", "2026-07-10"), ("c", "2025-07-01")], "k string, t string")
    return df.withColumn("t", F.col("t").cast("timestamp")), F.lit("2026-07-22").cast("timestamp")


def test_retention(spark):
    df, now = aged(spark)
    assert {r.k: r.tier for r in retention_tier(df, "t", now).collect()} == {"a": "hot", "b": "warm", "c": "deleted"}
    assert sorted(r.k for r in retained(df, "t", now).collect()) == ["a", "b"]


def test_increment_reaches_the_scan(spark, tmp_path):
    df, _ = aged(spark)
    df.write.parquet(str(tmp_path / "t"))
    fresh = increment(spark.read.parquet(str(tmp_path / "t")), "t", F.lit("2026-07-10").cast("timestamp"))
    assert sorted(r.k for r in fresh.collect()) == ["a", "b"]
    assert "GreaterThanOrEqual(t" in fresh._jdf.queryExecution().executedPlan().toString()


def test_daily_partitions_replace_only_their_days(spark, tmp_path):
    path = str(tmp_path / "days")
    df, _ = aged(spark)
    write_daily_partitions(df, path, ["k"], "t")
    write_daily_partitions(df.filter("k = 'a'").withColumn("k", F.lit("z")), path, ["k"], "t")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["b", "c", "z"]


def test_json_documents(spark):
    row = json_documents(spark.createDataFrame([(1, "x")], "id int, v string"), "id").first()
    assert (row.doc_id, json.loads(row.document)) == (1, {"id": 1, "v": "x"})


def test_leak_scan_finds_raw_values(spark):
    out = spark.createDataFrame([("acc1", "tok1"), ("acc1", "tok2"), (None, "acc2")], "shown string, token string")
    raw = spark.createDataFrame([("acc1",), ("acc2",)], "account string")
    assert {r.column: r.leaked_rows for r in privacy.leak_scan(out, ["shown", "token"], raw).collect()} == {"shown": 2, "token": 1}
