"""Score and feature drift by histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-6
ALERT = 0.25


def score_bin(score: Column, bins: int) -> Column:
    """Equal-width bin of a score in [0, 1]; 1 falls in the last."""
    return F.least(F.floor(score * bins), F.lit(bins - 1)).cast("bigint")


def histogram(df: DataFrame, keys: Sequence[str], bin_col: Column, bins: int) -> DataFrame:
    """Counts per key and bin, empty bins included, with the sample size of the key."""
    counts = df.groupBy(*keys, bin_col.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("sample_count"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "sample_count")


def psi(baseline: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Population stability index per key of two histograms; shares are floored at a millionth.

    ``status`` is OK, or tells why a key has no index: it stands on one side only (NO_BASELINE, NO_CURRENT),
    its bins differ (BINS_DIFFER), or a side has no samples (NO_SAMPLES). Other keys are not affected.
    """
    a = baseline.select(*keys, "bin", F.col("n").alias("expected"))
    b = current.select(*keys, "bin", F.col("n").alias("actual"))
    both = a.join(b, [*keys, "bin"], "full")
    w = Window.partitionBy(*keys)  # as many rows as bins

    def share(c: str) -> Column:
        return F.greatest(F.lit(FLOOR), F.col(c) / F.nullif(F.sum(c).over(w), F.lit(0)))

    e, a_ = F.col("e"), F.col("a")
    sides = both.select(*keys, "expected", "actual", share("expected").alias("e"), share("actual").alias("a"))
    index = sides.groupBy(*keys).agg(
        F.sum((a_ - e) * F.ln(a_ / e)).alias("psi"),
        F.when(F.count("expected") == 0, "NO_BASELINE")
        .when(F.count("actual") == 0, "NO_CURRENT")
        .when(F.count_if(F.col("expected").isNull() | F.col("actual").isNull()) > 0, "BINS_DIFFER")
        .when((F.sum("expected") == 0) | (F.sum("actual") == 0), "NO_SAMPLES")
        .otherwise("OK")
        .alias("status"),
    )
    return index.withColumn("psi", F.when(F.col("status") == "OK", F.col("psi")))


def alerts(psi_rows: DataFrame, threshold: float = ALERT) -> DataFrame:
    """The keys whose index is above the threshold."""
    return psi_rows.filter(F.col("psi") > threshold)


def drift_gauge(psi_rows: DataFrame, threshold: float = ALERT) -> DataFrame:
    """The one gauge that is watched: the largest index over all models, and whether it is above the threshold."""
    largest = psi_rows.agg(F.max("psi").alias("psi_max"))
    return largest.withColumn("alert", F.coalesce(F.col("psi_max") > threshold, F.lit(False)))


def monitor_snapshots(scored: DataFrame, baseline: DataFrame, window: str, bins: int = 10) -> DataFrame:
    """Score histograms per model and time window with their index against the model's baseline histogram.

    ``scored`` has model_id, scored_at and score; ``baseline`` has model_id, bin and n. One row per model and window:
    window_start, window_end, sample_count, histogram (counts by bin) and psi.
    """
    span = F.window("scored_at", window)
    windowed = scored.select("model_id", span.alias("w"), score_bin(F.col("score"), bins).alias("_bin"))
    windowed = windowed.select("model_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "_bin")
    keys = ["model_id", "window_start", "window_end"]
    current = histogram(windowed, keys, F.col("_bin"), bins)
    expected = current.select(*keys, "bin").join(baseline.select("model_id", "bin", "n"), ["model_id", "bin"], "left")
    index = psi(expected.filter("n IS NOT NULL"), current, keys)
    counts = current.groupBy(*keys).agg(
        F.first("sample_count").alias("sample_count"),
        F.transform(F.sort_array(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("histogram"),
    )
    return counts.join(index, keys)


def feature_bins(features: DataFrame, widths: dict[str, float], bins: int = 10) -> DataFrame:
    """Feature values as (feature, bin) rows, cut at multiples of each feature's width."""
    keep = [c for c in features.columns if c not in widths]
    long = features.unpivot(keep, list(widths), "feature", "value")
    width = F.element_at(F.create_map(*[F.lit(x) for pair in widths.items() for x in pair]), F.col("feature"))
    capped = F.greatest(F.lit(0), F.least(F.floor(F.col("value") / width), F.lit(bins - 1))).cast("bigint")
    return long.withColumn("bin", capped)
