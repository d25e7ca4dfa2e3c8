"""Model metrics over (model, label, score) rows, computed without collecting scores.

Equal scores are counted together first; then ranges of scores are accumulated side by side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import Running, chunks, running, value_cuts, value_ranges
from ..session import materialize
from ..sources.versioned import read_version, upsert

MODEL = "model"


def score_counts(scored: DataFrame) -> DataFrame:
    """Positives and negatives per model and distinct score: all that the ranking metrics need, and it adds up."""
    positive = (F.col("label") == 1).cast("bigint")
    return scored.groupBy(MODEL, "score").agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))


def merged_counts(stored: DataFrame, increment: DataFrame) -> DataFrame:
    """The counts of two disjoint sets of scored rows together."""
    return stored.unionByName(increment).groupBy(MODEL, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def update_counts(spark: SparkSession, path: str, scored: DataFrame, batch: tuple[str, int]) -> None:
    """Add newly scored rows to a stored table of counts, bucketed by model and score.

    Only the buckets of the scores that occur are rewritten; a batch that is delivered again adds nothing.
    """
    increment = materialize(score_counts(scored), "score-increment")
    stored = read_version(spark, path)
    if stored is not None:
        held = stored.join(increment.select(MODEL, "score"), [MODEL, "score"], "left_semi")
        increment = merged_counts(held, increment)
    upsert(spark, path, increment, [MODEL, "score"], ["pos", "neg"], batch=batch)


def metrics(counts: DataFrame, limit: float = 0.01) -> DataFrame:
    """All ranking metrics per model from its counts, in one pass."""
    return accumulated(counts).groupBy(MODEL).agg(_auc().alias("auc"), _ks().alias("ks"), _recall_at(limit).alias("recall_at_fpr"))


def cumulative(scored: DataFrame) -> DataFrame:
    """Per model and distinct score: counts of both classes at it, up to it, and in all."""
    return accumulated(score_counts(scored))


def accumulated(counts: DataFrame) -> DataFrame:
    counts = materialize(counts, "score-counts")
    cuts = value_cuts(counts, "score")
    ranged = value_ranges(counts, "score", "_range", cuts=cuts)
    values = [
        Running("cum_pos", F.col("pos")),
        Running("cum_neg", F.col("neg")),
        Running("all_pos", F.col("pos"), how="total"),
        Running("all_neg", F.col("neg"), how="total"),
    ]
    return running(ranged, [MODEL], chunks(cuts, "_range"), ["score"], values)


def _auc() -> Column:
    # a positive outranks the negatives below it and half of those at its score
    area = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    return area / (F.max("all_pos").cast("double") * F.max("all_neg"))


def _tpr() -> Column:
    return (F.col("all_pos") - F.col("cum_pos") + F.col("pos")) / F.col("all_pos")


def _fpr() -> Column:
    return (F.col("all_neg") - F.col("cum_neg") + F.col("neg")) / F.col("all_neg")


def _ks() -> Column:
    return F.max(F.abs(_tpr() - _fpr()))


def _recall_at(limit: float) -> Column:
    return F.coalesce(F.max(F.when(_fpr() <= limit, _tpr())), F.lit(0.0))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the curve by ranks, ties at their average."""
    return cumulative(scored).groupBy(MODEL).agg(_auc().alias("auc"))


def ks(scored: DataFrame) -> DataFrame:
    """Largest distance between true and false positive rates."""
    return cumulative(scored).groupBy(MODEL).agg(_ks().alias("ks"))


def recall_at_fpr(scored: DataFrame, limit: float = 0.01) -> DataFrame:
    """Best true positive rate while the false positive rate stays within the limit."""
    return cumulative(scored).groupBy(MODEL).agg(_recall_at(limit).alias("recall_at_fpr"))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts with precision (0 without predictions) and recall."""
    yes, hit = F.col("label") == 1, F.col("score") >= threshold

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    counts = scored.groupBy(MODEL).agg(n(yes & hit).alias("tp"), n(~yes & hit).alias("fp"), n(~yes & ~hit).alias("tn"), n(yes & ~hit).alias("fn"))
    predicted, actual = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    return counts.select(
        "*",
        F.when(predicted > 0, F.col("tp") / predicted).otherwise(0.0).alias("precision"),
        F.when(actual > 0, F.col("tp") / actual).otherwise(0.0).alias("recall"),
    )


def report(scored: DataFrame, threshold: float = 0.5, limit: float = 0.01) -> DataFrame:
    """All metrics per model and the release gate: every metric finite, auc from 0.5 to 1."""
    scored = materialize(scored.select(MODEL, "label", "score"), "scores")
    joined = metrics(score_counts(scored), limit).join(confusion(scored, threshold), MODEL)
    shown = ["auc", "ks", "recall_at_fpr", "precision", "recall"]

    def finite(c: str) -> Column:
        return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))

    passed = reduce(lambda a, b: a & b, [finite(c) for c in shown]) & F.col("auc").between(0.5, 1.0)
    return joined.withColumn("gate_passed", passed)
