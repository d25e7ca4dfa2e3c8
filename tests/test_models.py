"""Training, metrics and drift."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import drift, evaluation, readmodels, training
from riskloom.sources.schemas import MODEL_FEATURES
from riskloom.sources.versioned import read_version


def scored(spark, rows):
    return spark.createDataFrame([("m", *r) for r in rows], "model string, label int, score double")


def test_perfect_separation(spark):
    row = evaluation.report(scored(spark, [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)])).first()
    assert (row.auc, row.ks, row.tp, row.tn, row.fp, row.fn, row.recall_at_fpr, row.gate_passed) == (1.0, 1.0, 2, 2, 0, 0, 1.0, True)


def test_ties_give_half(spark):
    assert evaluation.auc(scored(spark, [(0, 0.5), (1, 0.5)])).first().auc == 0.5


def test_no_predictions_give_zero_precision(spark):
    row = evaluation.confusion(scored(spark, [(0, 0.1), (1, 0.2)])).first()
    assert (row.precision, row.recall) == (0.0, 0.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_metrics_equal_definition(spark, seed):
    rnd = random.Random(seed)
    rows = [(int(rnd.random() < 0.3), round(rnd.random(), 2)) for _ in range(400)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    rates = [(sum(p >= t for p in pos) / len(pos), sum(n >= t for n in neg) / len(neg)) for t in {s for _, s in rows}]
    row = evaluation.report(scored(spark, rows), limit=0.1).first()
    assert math.isclose(row.auc, auc)
    assert math.isclose(row.ks, max(abs(t - f) for t, f in rates))
    assert math.isclose(row.recall_at_fpr, max([t for t, f in rates if f <= 0.1], default=0.0))


def test_exact_quantiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 201)], "x double")
    row = readmodels.quantiles(df, "x", (0.5, 0.95)).first()
    assert (row.p50, row.p95) == (100.0, 190.0)


def histogram(spark, counts):
    return spark.createDataFrame([("m", i, n) for i, n in enumerate(counts)], "model string, bin bigint, n bigint")


def test_psi(spark):
    same = drift.psi(histogram(spark, [10, 20]), histogram(spark, [10, 20]), ["model"]).first().psi
    moved = drift.psi(histogram(spark, [90, 10]), histogram(spark, [10, 90]), ["model"])
    assert same == 0 and moved.first().psi > 1
    assert drift.alerts(moved).count() == 1


@pytest.mark.parametrize("a,b,status", [([1, 2], [1, 2, 3], "BINS_DIFFER"), ([0, 0], [1, 2], "NO_SAMPLES"), ([], [1, 2], "NO_BASELINE"), ([1, 2], [], "NO_CURRENT")])
def test_unfit_histograms_have_a_status_and_leave_others_alone(spark, a, b, status):
    good = histogram(spark, [5, 5]).withColumn("model", F.lit("good"))
    rows = {r.model: r for r in drift.psi(histogram(spark, a).union(good), histogram(spark, b).union(good), ["model"]).collect()}
    assert (rows["m"].status, rows["m"].psi) == (status, None)
    assert (rows["good"].status, rows["good"].psi) == ("OK", 0.0)


def test_largest_drift_is_watched(spark):
    rows = spark.createDataFrame([("a", 0.1), ("b", 0.3), ("c", None)], "model string, psi double")
    assert drift.drift_gauge(rows).first().asDict() == {"psi_max": 0.3, "alert": True}
    assert drift.drift_gauge(rows.limit(0)).first().asDict() == {"psi_max": None, "alert": False}


def test_histogram_has_every_bin(spark):
    df = spark.createDataFrame([("m", 0.0), ("m", 0.95), ("m", 1.0)], "model string, score double")
    rows = drift.histogram(df, ["model"], drift.score_bin(F.col("score"), 10), 10).orderBy("bin").collect()
    assert [r.n for r in rows] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 2] and rows[0].sample_count == 3


def training_rows(spark):
    rows = []
    for i in range(50):
        fraud = i < 15
        signal = 100.0 + i if fraud else 1.0 + i / 100
        rows.append(("s", str(i), signal, 2 * signal, 8.0 if fraud else 1.0, 2.0 if fraud else 12.0, float(fraud), float(fraud), float(fraud)))
    return spark.createDataFrame(rows, "source_id string, txn_id string, " + ", ".join(f"{c} double" for c in [*MODEL_FEATURES, "label"]))


def test_forest_separates_and_repeats(spark, tmp_path):
    data = training.prepared(training_rows(spark))
    assert data.filter("is_validation").count() == 50 // 5 - (15 % 5 + 35 % 5) // 5
    model = training.train_forest(data.filter("NOT is_validation"), trees=12)
    out = training.score(model, data.filter("is_validation"), "score").select(F.lit("m").alias("model"), F.col("label").cast("int").alias("label"), "score")
    assert evaluation.auc(out).first().auc >= 0.9
    training.save_artifact(model, evaluation.report(out), str(tmp_path), {"version": "v1"})
    again = training.score(training.load_artifact(str(tmp_path)), data.filter("is_validation"), "score")
    assert sorted(r.score for r in again.collect()) == sorted(r.score for r in out.collect())
    assert spark.read.json(f"{tmp_path}/manifest").first().feature_columns == MODEL_FEATURES


def test_small_training_set_is_refused(spark):
    with pytest.raises(ValueError):
        training.prepared(training_rows(spark).limit(10))


def test_split_takes_every_fifth_by_hash(spark):
    data = training_rows(spark)
    split = {r.txn_id: r.is_validation for r in training.stratified_split(data, target_rows=10).collect()}
    for label in (0.0, 1.0):
        ids = [r.txn_id for r in data.filter(F.col("label") == label).orderBy(F.xxhash64("source_id", "txn_id")).collect()]
        assert [split[i] for i in ids] == [n % 5 == 0 for n in range(1, len(ids) + 1)]


def test_search_clamps_page_and_size(spark):
    df = spark.createDataFrame([(f"d{i:03d}", f"t{i}", "HIGH", i) for i in range(150)], "decision_id string, txn_id string, risk_level string, s int")
    df = df.withColumn("created_at", F.timestamp_seconds("s"))
    rows = readmodels.search_decisions(df, page=-3, size=500).collect()
    assert len(rows) == 100 and rows[0].decision_id == "d149" and rows[0].total == 150
    assert readmodels.search_decisions(df, level="LOW", txn_id="t1").count() == 0


def test_trained_model_decides_and_is_validated(spark):
    from riskloom.operators import decisions as dec

    split = training.prepared(training_rows(spark))
    model = training.train_forest(split.filter("NOT is_validation"), trees=5, depth=3)
    report = evaluation.report(training.validation_scores(model, split, "forest")).first()
    assert report.tp + report.fp + report.tn + report.fn == split.filter("is_validation").count()
    asked = spark.createDataFrame(
        [("MOBILE_TRANSFER", "t1", "a", 100, None, None, "d", None, None, None, None)],
        "source_id string, txn_id string, account_no string, amount_minor bigint, counterparty string, channel string, device_id string, "
        "daily_amount bigint, daily_count bigint, txn_count bigint, device_new boolean",
    ).selectExpr(
        "*", "timestamp'2026-07-22 10:00:00' AS event_time", "false AS blacklist", "false AS device_blacklist", "true AS features_available", "'TRANSFER' AS biz_type",
        "CAST(null AS bigint) AS known_device_count", "CAST(null AS bigint) AS unique_counterparty_count", "CAST(null AS date) AS daily_stat_date",
        "CAST(null AS timestamp) AS feature_event_time",
    )
    row = dec.decide(asked, "k", training.scorer(model), model_version="forest").first()
    assert 0 <= row.fraud_score <= 1 and row.model_version == "forest" and row.daily_amount is None


def test_counts_of_increments_add_up(spark, tmp_path):
    """Metrics from stored counts equal those from all rows, whatever the increments, and a repeated one adds nothing."""
    rnd = random.Random(21)
    rows = [(m, rnd.randrange(2), round(rnd.random(), 2)) for m in ("a", "b") for _ in range(300)]
    everything = spark.createDataFrame(rows, "model string, label int, score double")
    path = str(tmp_path / "counts")
    for number, (low, high) in enumerate([(0, 100), (100, 450), (450, 600), (450, 600)]):
        part = spark.createDataFrame(rows[low:high], everything.schema)
        evaluation.update_counts(spark, path, part, ("scores", min(number, 2)))
    counts = read_version(spark, path)
    assert counts.agg({"pos": "sum"}).first()[0] + counts.agg({"neg": "sum"}).first()[0] == 600
    got = {r.model: (r.auc, r.ks, r.recall_at_fpr) for r in evaluation.metrics(counts).collect()}
    for model, (auc, ks, recall) in got.items():
        own = everything.filter(F.col("model") == model)
        assert math.isclose(auc, evaluation.auc(own).first().auc) and math.isclose(ks, evaluation.ks(own).first().ks)
        assert math.isclose(recall, evaluation.recall_at_fpr(own).first().recall_at_fpr)


@pytest.mark.parametrize("error", [0.01, 0.05])
def test_sketched_quantiles_stay_within_their_error(spark, error):
    """Sketches of five-minute windows, rolled up to hours, against the exact lower quantiles."""
    rnd = random.Random(4)
    rows = [(f"2026-07-22 {h:02d}:{rnd.randrange(60):02d}:00", int(rnd.lognormvariate(3, 2)) - 1) for h in range(3) for _ in range(400)]
    df = spark.createDataFrame(rows, "created_at string, cost_ms bigint").withColumn("created_at", F.col("created_at").cast("timestamp"))
    fine = readmodels.latency_sketch(df, "5 minutes", error)
    halves = [readmodels.latency_sketch(df.filter(F.pmod("cost_ms", F.lit(2)) == k), "5 minutes", error) for k in (0, 1)]
    probabilities = (0.5, 0.99, 0.999)
    for sketch in (fine, readmodels.rolled_up(halves[0].unionByName(halves[1]), "5 minutes")):
        hours = readmodels.sketch_quantiles(readmodels.rolled_up(sketch, "1 hour"), probabilities, error).collect()
        assert len(hours) == 3
        for row in hours:
            own = sorted(v for t, v in rows if t.startswith(row.window_start.strftime("%Y-%m-%d %H")))
            assert row.decisions == len(own)
            for p in probabilities:
                exact = max(own[math.ceil(p * len(own)) - 1], 0)
                assert abs(row[f"{readmodels.percent_name(p)}_ms"] - exact) <= error * exact + 1e-9


def test_replay_keeps_the_whole_payload(spark):
    payload = '{"metadata":{"eventId":"old","occurredAt":"then","schemaVersion":1,"trace":{"a":[1,2.5,null]}},"decisionId":"d1","added":{"x":"1","y":1},"big":12345678901234567890}'
    row = (("m1", "Decision", "d1", "decision.v1", "k", payload, "2026-07-22 00:00:00"),)
    schema = "event_id string, aggregate_type string, aggregate_id string, topic string, message_key string, payload string, created_at string"
    wanted = spark.createDataFrame([("d1",)], "decision_id string")
    out = readmodels.replay(spark.createDataFrame(row, schema), wanted, F.lit("2026-07-23 01:02:03").cast("timestamp")).first()
    before, after = json.loads(payload), json.loads(out.payload)
    assert (after["metadata"].pop("eventId"), after["metadata"].pop("occurredAt")) == (out.event_id, "2026-07-23T01:02:03.000000Z")
    assert (before["metadata"].pop("eventId"), before["metadata"].pop("occurredAt")) == ("old", "then")
    assert after == before
