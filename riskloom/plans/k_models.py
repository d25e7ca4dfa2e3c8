"""Queries on training, evaluation and drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import drift, evaluation, features, training
from ..session import materialize, shared_path
from ..sources import tables
from ..sources.versioned import read_version
from .c_features import MODEL_FEATURES_SQL, as_of
from .e_decisions import decided, records
from .oracle import ASOF, CASE_LABEL, DECISIONS, FEAT, TXN
from .registry import query

_SET = f"""{TXN}, {FEAT}, {ASOF}, {MODEL_FEATURES_SQL}, {CASE_LABEL}, tset AS (
  SELECT m.* EXCLUDE (event_id), CASE WHEN label = 'FRAUD' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM modelf m JOIN case_label USING (source_id, txn_id))"""


def training_rows(spark, sf, inputs=None):
    """Labelled model inputs; ``inputs`` are those of all transactions, where they are stored already."""
    inputs = features.model_features(as_of(spark, sf)) if inputs is None else inputs
    return training.training_set(inputs.drop("event_id"), tables.case_labels(spark, sf))


def trained(spark, sf, inputs=None):
    """The split training rows. The labelled set is stored once; tree building passes over the cached split."""
    return training.prepared(materialize(training_rows(spark, sf, inputs), "training-set")).persist()


@query("training_set", f"WITH {_SET} SELECT * FROM tset")
def training_set(spark, sf):
    return training_rows(spark, sf)


@query(
    "class_weights",
    f"""WITH {_SET}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative FROM tset)
      SELECT *, negative / positive AS positive_weight, total >= 20 AND positive >= 5 AND negative >= 5 AS trainable FROM s""",
)
def class_weights(spark, sf):
    return training.class_weights(training_rows(spark, sf))


@query(
    "stratified_split",
    f"""WITH {_SET}, s AS (SELECT label, count(*) AS n FROM tset GROUP BY 1)
      SELECT label, true AS is_validation, n // 5 AS n FROM s UNION ALL SELECT label, false, n - n // 5 FROM s""",
)
def stratified_split(spark, sf):
    split = training.stratified_split(training_rows(spark, sf))
    return split.groupBy("label", "is_validation").agg(F.count(F.lit(1)).alias("n"))


def _forest(spark, sf, inputs=None):
    rows = trained(spark, sf, inputs)
    model = training.train_forest(rows.filter(~F.col("is_validation")))
    rows.unpersist()
    return model


@query("forest_feature_importance")
def forest_feature_importance(spark, sf):
    return training.feature_importance(spark, _forest(spark, sf))


@query("model_scores")
def model_scores(spark, sf):
    """The trained forest over every transaction."""
    inputs = materialize(features.model_features(as_of(spark, sf)), "model-inputs")
    scored = training.score(_forest(spark, sf, inputs), inputs)
    return scored.select("event_id", "fraud_score")


@query("tree_rules")
def tree_rules(spark, sf):
    rows = trained(spark, sf)
    model = training.train_tree(rows.filter(~F.col("is_validation")))
    rows.unpersist()
    return training.tree_lines(spark, model)


@query("forest_importance_check", "SELECT CAST(6 AS BIGINT) AS features, 1.0::DOUBLE AS total, true AS all_valid")
def forest_importance_check(spark, sf):
    """Importances are shares of one, one per model feature."""
    share = F.col("importance")
    return forest_feature_importance(spark, sf).agg(
        F.count("*").alias("features"), F.round(F.sum(share), 6).alias("total"), F.every(share.between(0, 1)).alias("all_valid")
    )


@query("tree_rules_check", "SELECT true AS has_branches, true AS names_features")
def tree_rules_check(spark, sf):
    lines = tree_rules(spark, sf)
    named = "|".join(training.MODEL_FEATURES)
    tests = F.col("rule").rlike(r"(If|Else) \(")
    return lines.agg((F.count_if(tests) > 0).alias("has_branches"), F.every(~tests | F.col("rule").rlike(named)).alias("names_features"))


@query("model_scores_check", f"WITH {TXN} SELECT count(*) AS transactions, count(*) AS in_range FROM txn")
def model_scores_check(spark, sf):
    """One score from 0 to 1 for every transaction."""
    return model_scores(spark, sf).agg(F.count_distinct("event_id").alias("transactions"), F.count_if(F.col("fraud_score").between(0, 1)).alias("in_range"))


@query(
    "decisions_by_forest",
    f"""WITH {DECISIONS} SELECT decision_id, rule_version, CASE model_version WHEN 'fraud-1' THEN 'forest-1' ELSE model_version END AS model_version,
      coalesce(list_aggregate(list_filter(string_split(hit_rules, ','), lambda c: c NOT LIKE 'MODEL_%'), 'string_agg', ','), '') AS other_hits,
      true AS score_valid, true AS model_hits_follow_score FROM decision""",
)
def decisions_by_forest(spark, sf):
    """Decisions with the trained forest as their model: what does not come from the model is as before, and
    its rules follow its score."""
    out = decided(spark, sf, training.scorer(_forest(spark, sf)), model_version="forest-1")
    score, hits = F.col("fraud_score"), F.col("hit_rules")
    follows = (F.array_contains(hits, "MODEL_HIGH_RISK") == (score > 0.9)) & (F.array_contains(hits, "MODEL_MID_RISK") == ((score > 0.6) & (score <= 0.9)))
    return out.select(
        "decision_id", "rule_version", "model_version",
        F.array_join(F.filter(hits, lambda c: ~c.startswith("MODEL_")), ",").alias("other_hits"),
        score.between(0, 1).alias("score_valid"), follows.alias("model_hits_follow_score"),
    )


@query(
    "forest_validation",
    f"""WITH {_SET}, s AS (SELECT label, count(*) // 5 AS n FROM tset GROUP BY 1)
      SELECT 'forest-1' AS model, CAST(sum(n) AS BIGINT) AS validation_rows, true AS metrics_finite FROM s""",
)
def forest_validation(spark, sf):
    """Train, score the held-out rows, report: their number, and that every metric is a number from 0 to 1."""
    rows = trained(spark, sf)
    scores = training.validation_scores(training.train_forest(rows.filter(~F.col("is_validation"))), rows, "forest-1")
    report = evaluation.report(scores)
    metrics = [F.coalesce(F.col(c).between(0, 1), F.lit(False)) for c in ("auc", "ks", "recall_at_fpr", "precision", "recall")]
    good = reduce(lambda a, b: a & b, metrics)
    return report.select("model", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("validation_rows"), good.alias("metrics_finite"))


_SCORES = f"""{DECISIONS}, {CASE_LABEL}, ev AS (
  SELECT 'fraud-1' AS model, CASE WHEN label = 'FRAUD' THEN 1 ELSE 0 END AS label, fraud_score AS score FROM decision JOIN case_label USING (source_id, txn_id)
  UNION ALL
  SELECT 'amount', CASE WHEN label = 'FRAUD' THEN 1 ELSE 0 END, least(amount_minor / 40000000.0::DOUBLE, 1.0) FROM txn JOIN case_label USING (source_id, txn_id)),
cum AS (
  SELECT *, sum(pos) OVER up AS cp, sum(neg) OVER up AS cn, sum(pos) OVER m AS p, sum(neg) OVER m AS n FROM (
    SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM ev GROUP BY 1, 2)
  WINDOW up AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING), m AS (PARTITION BY model)),
ranked AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM ev)"""
_AUC = """SELECT model, round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 9) AS auc FROM ranked GROUP BY model"""
_KS = "SELECT model, round(max(abs(cp / p - cn / n)), 9) AS ks FROM cum GROUP BY model"
_RECALL = "SELECT model, round(coalesce(max(cp / p) FILTER (WHERE cn / n <= 0.01), 0), 9) AS recall_at_fpr FROM cum GROUP BY model"
_CONFUSION = """SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM (
  SELECT model, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
    count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn FROM ev GROUP BY 1)"""


def scored(spark, sf):
    """Labelled scores of the decision model and of a plain amount score."""
    labels = tables.case_labels(spark, sf).select("source_id", "txn_id", (F.col("label") == "FRAUD").cast("int").alias("label"))
    keys = ["source_id", "txn_id"]
    # only labelled transactions are scored and decided; their features still come from all events
    asked = as_of(spark, sf).join(labels.select(*keys), keys, "left_semi")
    scores = decided(spark, sf, asked=asked).join(labels, keys)
    scores = scores.select(F.lit("fraud-1").alias("model"), "label", F.col("fraud_score").alias("score"))
    plain = F.least(F.col("amount_minor") / 40_000_000.0, F.lit(1.0))
    amounts = tables.transactions(spark, sf).join(labels, keys).select(F.lit("amount").alias("model"), "label", plain.alias("score"))
    return scores.unionByName(amounts)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("metric_auc", f"WITH {_SCORES} {_AUC}")
def metric_auc(spark, sf):
    return _rounded(evaluation.auc(scored(spark, sf)), "auc")


@query("metric_ks", f"WITH {_SCORES} {_KS}")
def metric_ks(spark, sf):
    return _rounded(evaluation.ks(scored(spark, sf)), "ks")


@query("metric_recall_at_fpr", f"WITH {_SCORES} {_RECALL}")
def metric_recall_at_fpr(spark, sf):
    return _rounded(evaluation.recall_at_fpr(scored(spark, sf)), "recall_at_fpr")


@query("metric_by_increment", f"WITH {_SCORES}, a AS ({_AUC}), k AS ({_KS}), r AS ({_RECALL}) SELECT * FROM a JOIN k USING (model) JOIN r USING (model)")
def metric_by_increment(spark, sf):
    """The scores arrive in three increments, the last one twice; the metrics come from the stored counts."""
    path, rows = shared_path(spark, "score-counts"), materialize(scored(spark, sf), "scores")
    part = F.pmod(F.xxhash64("model", "score", "label"), F.lit(3))
    for number in (0, 1, 2, 2):
        evaluation.update_counts(spark, path, rows.filter(part == number), ("scores", number))
    return _rounded(evaluation.metrics(read_version(spark, path)), "auc", "ks", "recall_at_fpr")


@query("metric_confusion", f"WITH {_SCORES} {_CONFUSION}")
def metric_confusion(spark, sf):
    return _rounded(evaluation.confusion(scored(spark, sf)), "precision", "recall")


@query(
    "evaluation_report",
    f"""WITH {_SCORES}, a AS ({_AUC}), k AS ({_KS}), r AS ({_RECALL}), c AS ({_CONFUSION})
      SELECT *, auc BETWEEN 0.5 AND 1.0 AS gate_passed FROM a JOIN k USING (model) JOIN r USING (model) JOIN c USING (model)""",
)
def evaluation_report(spark, sf):
    return _rounded(evaluation.report(scored(spark, sf)), "auc", "ks", "recall_at_fpr", "precision", "recall")


# night decisions score higher by construction, so day against night shows drift
_HIST = f"""{DECISIONS}, b AS (SELECT source_id, hour(created_at) < 6 AS night, least(floor(fraud_score * 10), 9)::BIGINT AS bin FROM decision),
grid AS (SELECT DISTINCT source_id, night, unnest(range(10)) AS bin FROM b),
hist AS (SELECT g.source_id, g.night, g.bin, count(b.bin) AS n, CAST(sum(count(b.bin)) OVER (PARTITION BY g.source_id, g.night) AS BIGINT) AS sample_count
  FROM grid g LEFT JOIN b ON b.source_id = g.source_id AND b.night = g.night AND b.bin = g.bin GROUP BY 1, 2, 3)"""
_PSI = """psi AS (SELECT d.source_id, round(sum((greatest(1e-6, c.n / c.sample_count) - greatest(1e-6, d.n / d.sample_count))
    * ln(greatest(1e-6, c.n / c.sample_count) / greatest(1e-6, d.n / d.sample_count))), 6) AS psi
  FROM hist d JOIN hist c ON c.source_id = d.source_id AND c.bin = d.bin WHERE NOT d.night AND c.night GROUP BY 1)"""


def histograms(spark, sf):
    rows = records(spark, sf).withColumn("night", F.hour("created_at") < 6)
    return drift.histogram(rows, ["source_id", "night"], drift.score_bin(F.col("fraud_score"), 10), 10)


def score_psi(spark, sf):
    h = materialize(histograms(spark, sf), "histograms")
    return drift.psi(h.filter(~F.col("night")), h.filter("night"), ["source_id"])


@query("score_histogram", f"WITH {_HIST} SELECT * FROM hist")
def score_histogram(spark, sf):
    return histograms(spark, sf)


@query("model_psi", f"WITH {_HIST}, {_PSI} SELECT *, 'OK' AS status FROM psi")
def model_psi(spark, sf):
    return _six(score_psi(spark, sf))


@query("model_drift_alerts", f"WITH {_HIST}, {_PSI} SELECT *, 'OK' AS status FROM psi WHERE psi > 0.05")
def model_drift_alerts(spark, sf):
    return _six(drift.alerts(score_psi(spark, sf), 0.05))


@query("model_drift_gauge", f"WITH {_HIST}, {_PSI} SELECT max(psi) AS psi_max, max(psi) > 0.25 AS alert FROM psi")
def model_drift_gauge(spark, sf):
    out = drift.drift_gauge(score_psi(spark, sf))
    return out.withColumn("psi_max", F.round("psi_max", 6))


@query(
    "model_monitor_snapshots",
    f"""WITH {DECISIONS}, s AS (SELECT model_version AS model_id, date_trunc('day', created_at) AS d, least(floor(fraud_score * 10), 9)::BIGINT AS bin FROM decision),
      g AS (SELECT model_id, d, unnest(range(10)) AS bin FROM (SELECT DISTINCT model_id, d FROM s)),
      c AS (SELECT g.model_id, g.d, g.bin, count(s.bin) AS n FROM g LEFT JOIN s ON s.model_id = g.model_id AND s.d = g.d AND s.bin = g.bin GROUP BY ALL),
      b AS (SELECT model_id, bin, sum(n) AS n FROM c GROUP BY ALL),
      x AS (SELECT c.*, greatest(1e-6, c.n / sum(c.n) OVER (PARTITION BY c.model_id, c.d)) AS a, greatest(1e-6, b.n / sum(b.n) OVER (PARTITION BY c.model_id, c.d)) AS e
        FROM c JOIN b USING (model_id, bin))
      SELECT model_id, epoch_us(d) AS window_start_us, CAST(sum(n) AS BIGINT) AS sample_count, string_agg(n, ',' ORDER BY bin) AS histogram,
        round(sum((a - e) * ln(a / e)), 6) AS psi FROM x GROUP BY model_id, d""",
)
def model_monitor_snapshots(spark, sf):
    """Each day of each model against all its days."""
    rows = records(spark, sf).select(F.col("model_version").alias("model_id"), F.col("created_at").alias("scored_at"), F.col("fraud_score").alias("score"))
    rows = materialize(rows, "model-scores")
    baseline = drift.histogram(rows, ["model_id"], drift.score_bin(F.col("score"), 10), 10)
    out = _six(drift.monitor_snapshots(rows, baseline, "1 day"))
    start = F.unix_micros("window_start").alias("window_start_us")
    return out.select("model_id", start, "sample_count", F.concat_ws(",", F.col("histogram").cast("array<string>")).alias("histogram"), "psi")


def _six(df):
    return df.withColumn("psi", F.round("psi", 6))


WIDTHS = {"amount": 5_000.0, "daily_amount": 20_000.0, "daily_count": 2.0, "hour": 3.0, "cross_bank": 0.5, "device_new": 0.5}


@query(
    "feature_psi",
    f"""WITH {TXN}, {FEAT}, {ASOF}, {MODEL_FEATURES_SQL}, w(feature, width) AS (VALUES {", ".join(f"('{f}', {w}::DOUBLE)" for f, w in WIDTHS.items())}),
      long AS (SELECT feature, value, source_id = 'ATM_NET' AS cur FROM modelf UNPIVOT (value FOR feature IN ({", ".join(WIDTHS)}))
        WHERE source_id IN ('ATM_NET', 'WEB_BANK')),
      b AS (SELECT l.feature, cur, greatest(0, least(floor(value / width), 9))::BIGINT AS bin FROM long l JOIN w USING (feature)),
      grid AS (SELECT feature, unnest(range(10)) AS bin FROM w),
      h AS (SELECT g.feature, g.bin, count(*) FILTER (WHERE b.cur) AS c, count(*) FILTER (WHERE NOT b.cur) AS e FROM grid g
        LEFT JOIN b ON b.feature = g.feature AND b.bin = g.bin GROUP BY 1, 2),
      s AS (SELECT feature, greatest(1e-6, c / sum(c) OVER (PARTITION BY feature)) AS a, greatest(1e-6, e / sum(e) OVER (PARTITION BY feature)) AS e FROM h)
      SELECT feature, round(sum((a - e) * ln(a / e)), 6) AS psi, 'OK' AS status FROM s GROUP BY 1""",
)
def feature_psi(spark, sf):
    """Feature distributions of two sources against each other."""
    both = features.model_features(as_of(spark, sf)).filter(F.col("source_id").isin("WEB_BANK", "ATM_NET"))
    rows = drift.feature_bins(both, WIDTHS)
    h = materialize(drift.histogram(rows, ["source_id", "feature"], F.col("bin"), 10), "histograms")
    base, current = h.filter(F.col("source_id") == "WEB_BANK"), h.filter(F.col("source_id") == "ATM_NET")
    return _six(drift.psi(base, current, ["feature"]))
