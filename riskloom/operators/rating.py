"""Customer rating: configured score rules over tags, and grade bands over the total."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ScoreRule:
    model: str
    code: str
    field: str
    operator: str
    threshold: float
    score: int
    enabled: bool = True


@dataclass(frozen=True)
class GradeBand:
    model: str
    grade: str
    min_score: int


# The published rating model.
SCORE_RULES = (
    ScoreRule("RISK_M1", "HIGH_AMOUNT_90D", "amount_90d", "GT", 1_000_000, 30),
    ScoreRule("RISK_M1", "HIGH_FREQ_90D", "txn_cnt_90d", "GT", 200, 20),
    ScoreRule("RISK_M1", "MANY_COUNTERPART", "counterparty", "GT", 50, 20),
    ScoreRule("RISK_M1", "LOW_BALANCE", "avg_balance", "LT", 1_000, 15),
    ScoreRule("RISK_M1", "NIGHT_ACTIVE", "night_ratio", "GT", 0.5, 15),
)
GRADE_BANDS = (
    GradeBand("RISK_M1", "D", 70),
    GradeBand("RISK_M1", "C", 45),
    GradeBand("RISK_M1", "B", 20),
    GradeBand("RISK_M1", "A", 0),
)
_COMPARE = {
    "GT": lambda c, t: c > t,
    "GE": lambda c, t: c >= t,
    "LT": lambda c, t: c < t,
    "LE": lambda c, t: c <= t,
    "EQ": lambda c, t: c == t,
}


def feature_wide(profiles: DataFrame, rfm_tags: DataFrame) -> DataFrame:
    """The customer feature table the rating reads, from profiles and tags of the same customers."""
    return profiles.join(rfm_tags.drop("recency_days"), "customer_id").select(
        F.col("customer_id").alias("cust_id"),
        F.col("frequency_30d").alias("txn_cnt_30d"),
        "txn_cnt_90d",
        F.col("monetary_30d").alias("txn_amt_30d"),
        F.col("amount_90d").alias("txn_amt_90d"),
        F.col("avg_amount_30d").alias("avg_amt"),
        F.col("max_amount_90d").alias("max_amt"),
        "recency_days",
        F.col("night_ratio").alias("night_txn_ratio"),
        F.col("unique_counterparty_90d").alias("counterparty_cnt"),
    )


def rating_input(wide: DataFrame, tags: DataFrame) -> DataFrame:
    """Customers present on both sides; a column of both comes from the tags, the other gets a prefix."""
    both = (set(wide.columns) & set(tags.columns)) - {"cust_id"}
    renamed = wide.select(*[F.col(c).alias(f"wide_{c}" if c in both else c) for c in wide.columns])
    return renamed.join(tags, "cust_id")


def numeric_tags(df: DataFrame) -> DataFrame:
    """Numeric columns widened to double; other columns but the key are left out."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != "cust_id"]
    return df.select("cust_id", *[F.col(c).cast("double").alias(c) for c in numeric])


def tags_long(df: DataFrame) -> DataFrame:
    """One row per customer and numeric tag that has a value."""
    wide = numeric_tags(df)
    long = wide.unpivot("cust_id", [c for c in wide.columns if c != "cust_id"], "field", "value")
    return long.filter(F.col("value").isNotNull())


def _hit(df: DataFrame, r: ScoreRule) -> Column:
    if r.operator not in _COMPARE or r.field not in df.columns:
        return F.lit(False)
    return F.coalesce(_COMPARE[r.operator](F.col(r.field), F.lit(float(r.threshold))), F.lit(False))


def score(df: DataFrame, rules: Sequence[ScoreRule] = SCORE_RULES, model: str = "RISK_M1") -> DataFrame:
    """Total score and sorted hit list under a model's enabled rules, in one pass over wide rows.

    An unknown operator, an unknown field or a missing value is no hit.
    """
    tags = numeric_tags(df)
    active = [r for r in rules if r.enabled and r.model == model]
    total = sum((F.when(_hit(tags, r), r.score).otherwise(0) for r in active), F.lit(0))
    hits = F.array_compact(F.array(*[F.when(_hit(tags, r), F.lit(r.code)) for r in active]))
    return tags.select("cust_id", total.cast("bigint").alias("total_score"), F.array_sort(hits).alias("hit_rules"))


def grade(scores: DataFrame, bands: Sequence[GradeBand] = GRADE_BANDS, model: str = "RISK_M1") -> DataFrame:
    """Add the grade of the highest band the total reaches, A where it reaches none."""
    out = F.when(F.lit(False), F.lit(""))
    for b in sorted((b for b in bands if b.model == model), key=lambda b: -b.min_score):
        out = out.when(F.col("total_score") >= b.min_score, b.grade)
    return scores.withColumn("grade", out.otherwise("A"))


def grade_distribution(graded: DataFrame) -> DataFrame:
    return graded.groupBy("grade").agg(F.count(F.lit(1)).alias("customers"))
