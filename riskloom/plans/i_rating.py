"""Queries on customer rating."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rating
from ..session import materialize
from ..sources import tables
from .g_profile import PROFILE, exact_profiles
from .h_tags import RFM_SQL, rfm
from .registry import query


def wide(spark, sf, profiles=None):
    return rating.feature_wide(exact_profiles(spark, sf) if profiles is None else profiles, rfm(spark, sf))


def tags(spark, sf, profiles=None):
    profiles = exact_profiles(spark, sf) if profiles is None else profiles
    customer = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("cust_id"), F.col("c_acctbal").alias("avg_balance"), "c_mktsegment")
    night = profiles.select(F.col("customer_id").alias("cust_id"), "night_ratio")
    return customer.join(night, "cust_id", "left")


def rated_input(spark, sf):
    """Wide table joined with tags; the rating reads money in major units."""
    profiles = materialize(exact_profiles(spark, sf), "profiles")  # both sides read it
    joined = rating.rating_input(wide(spark, sf, profiles), tags(spark, sf, profiles))
    return joined.withColumn("amount_90d", F.col("txn_amt_90d") / 100.0).withColumnRenamed("counterparty_cnt", "counterparty")


WIDE = f"""
{PROFILE}, {RFM_SQL}, wide AS (
  SELECT e.customer_id AS cust_id, frequency_30d AS txn_cnt_30d, txn_cnt_90d, monetary_30d AS txn_amt_30d, amount_90d AS txn_amt_90d,
    avg_amount_30d AS avg_amt, max_amount_90d AS max_amt, e.recency_days, night_ratio AS night_txn_ratio, unique_counterparty_90d AS counterparty_cnt
  FROM exact e JOIN rfm r ON r.customer_id = e.customer_id)"""

INPUT = f"""
{WIDE}, input AS (
  SELECT cust_id, txn_cnt_30d, txn_cnt_90d, txn_amt_30d, txn_amt_90d, avg_amt, max_amt, wide.recency_days, night_txn_ratio,
    counterparty_cnt AS counterparty, c_acctbal AS avg_balance, c_mktsegment, x.night_ratio, txn_amt_90d / 100.0::DOUBLE AS amount_90d
  FROM wide JOIN customer ON c_custkey = cust_id LEFT JOIN (SELECT customer_id, night_ratio FROM exact) x ON x.customer_id = cust_id)"""

SCORED = f"""
{INPUT}, scored AS (
  SELECT cust_id, CAST(if(amount_90d > 1000000, 30, 0) + if(txn_cnt_90d > 200, 20, 0) + if(counterparty > 50, 20, 0) + if(avg_balance < 1000, 15, 0)
      + if(night_ratio > 0.5, 15, 0) AS BIGINT) AS total_score,
    concat_ws(',', if(amount_90d > 1000000, 'HIGH_AMOUNT_90D', NULL), if(txn_cnt_90d > 200, 'HIGH_FREQ_90D', NULL), if(avg_balance < 1000, 'LOW_BALANCE', NULL),
      if(counterparty > 50, 'MANY_COUNTERPART', NULL), if(night_ratio > 0.5, 'NIGHT_ACTIVE', NULL)) AS hit_rules
  FROM input),
graded AS (SELECT *, CASE WHEN total_score >= 70 THEN 'D' WHEN total_score >= 45 THEN 'C' WHEN total_score >= 20 THEN 'B' ELSE 'A' END AS grade FROM scored)"""


@query("cust_feature_wide", f"WITH {WIDE} SELECT * FROM wide")
def cust_feature_wide(spark, sf):
    return wide(spark, sf)


@query("rating_input", f"WITH {INPUT} SELECT * FROM input")
def rating_input(spark, sf):
    return rated_input(spark, sf)


_FIELDS = "txn_cnt_30d txn_cnt_90d txn_amt_30d txn_amt_90d avg_amt max_amt recency_days night_txn_ratio counterparty avg_balance night_ratio amount_90d".split()


@query(
    "rating_tags_long",
    f"WITH {INPUT} " + " UNION ALL ".join(f"SELECT cust_id, '{f}' AS field, {f}::DOUBLE AS value FROM input WHERE {f} IS NOT NULL" for f in _FIELDS),
)
def rating_tags_long(spark, sf):
    return rating.tags_long(rated_input(spark, sf))


def scores(spark, sf):
    return rating.score(rated_input(spark, sf))


@query("rating_scores", f"WITH {SCORED} SELECT cust_id, total_score, hit_rules FROM scored")
def rating_scores(spark, sf):
    return scores(spark, sf).withColumn("hit_rules", F.concat_ws(",", "hit_rules"))


@query("rating_grades", f"WITH {SCORED} SELECT cust_id, total_score, grade FROM graded")
def rating_grades(spark, sf):
    return rating.grade(scores(spark, sf)).select("cust_id", "total_score", "grade")


@query("rating_distribution", f"WITH {SCORED} SELECT grade, count(*) AS customers FROM graded GROUP BY 1")
def rating_distribution(spark, sf):
    return rating.grade_distribution(rating.grade(scores(spark, sf)))
