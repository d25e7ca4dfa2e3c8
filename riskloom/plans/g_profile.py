"""Queries on 90-day profiles of the order facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingestion, profile
from ..session import materialize, shared_path
from ..sources import tables
from ..sources.sinks import read_latest, write_documents
from .oracle import FACT, FACT_LABEL
from .registry import query

AS_OF, WATERMARK = "2001-08-02 00:00:00", "2001-07-20 00:00:00"


def ts(text):
    return F.lit(text).cast("timestamp")


AFFECTED = f"""
affected AS (
  SELECT customer_id FROM fact WHERE event_time >= TIMESTAMP '{WATERMARK}'
    OR (event_time < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAYS AND event_time >= TIMESTAMP '{WATERMARK}' - INTERVAL 90 DAYS)
  UNION
  SELECT customer_id FROM fact JOIN fact_label USING (source_id, txn_id) WHERE fact_label.created_at >= TIMESTAMP '{WATERMARK}')"""

WINDOWED = f"""
windowed AS (
  SELECT f.*, CASE WHEN l.label = 'FRAUD' THEN 1 ELSE 0 END AS fraud FROM fact f LEFT JOIN fact_label l USING (source_id, txn_id)
  WHERE event_time >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAYS AND event_time < TIMESTAMP '{AS_OF}' + INTERVAL 1 SECOND)"""

EXACT = f"""
exact AS (
  SELECT customer_id, CAST(sum(amount_minor) AS BIGINT) AS amount_90d, count(*) AS txn_cnt_90d,
    count(DISTINCT counterparty_id) AS unique_counterparty_90d,
    CAST((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(event_time))) // 86400000000 AS INTEGER) AS recency_days,
    avg(CASE WHEN hour(event_time) < 6 OR hour(event_time) >= 23 THEN 1 ELSE 0 END) AS night_ratio,
    CAST(sum(fraud) AS BIGINT) AS fraud_count_90d, epoch_us(max(event_time)) AS profile_as_of_us
  FROM windowed GROUP BY customer_id)"""

PROFILE = f"{FACT}, {FACT_LABEL}, {AFFECTED}, {WINDOWED}, {EXACT}"


def exact_profiles(spark, sf):
    return profile.profile_90d_exact(tables.facts(spark, sf), tables.fact_labels(spark, sf), ts(AS_OF))


def incremental(spark, sf, exact=True):
    return profile.profile_90d(tables.facts(spark, sf), tables.fact_labels(spark, sf), ts(WATERMARK), ts(AS_OF), exact=exact)


def shown(df):
    return df.withColumn("profile_as_of_us", F.unix_micros("profile_as_of")).drop("profile_as_of")


@query("profile_affected", f"WITH {PROFILE} SELECT customer_id FROM affected")
def profile_affected(spark, sf):
    return profile.affected_customers(tables.facts(spark, sf), tables.fact_labels(spark, sf), ts(WATERMARK), ts(AS_OF))


_PROFILE_90D = f"""
SELECT a.customer_id, coalesce(amount_90d, 0) AS amount_90d, coalesce(txn_cnt_90d, 0) AS txn_cnt_90d,
  coalesce(unique_counterparty_90d, 0) AS unique_counterparty_90d,
  CAST(coalesce(date_diff('day', make_timestamp(profile_as_of_us), TIMESTAMP '{AS_OF}'), 91) AS INTEGER) AS recency_days,
  coalesce(night_ratio, 0.0) AS night_ratio, coalesce(fraud_count_90d, 0) AS fraud_count_90d,
  coalesce(profile_as_of_us, epoch_us(TIMESTAMP '{AS_OF}')) AS profile_as_of_us
FROM affected a LEFT JOIN exact e ON e.customer_id = a.customer_id"""


@query("profile_90d", f"WITH {PROFILE} {_PROFILE_90D}")
def profile_90d(spark, sf):
    return shown(incremental(spark, sf))


@query("profile_90d_partials", f"WITH {PROFILE} {_PROFILE_90D}")
def profile_90d_partials(spark, sf):
    """The daily partials are stored, those of July a second time; the profile is merged from them."""
    path, facts = shared_path(spark, "partials"), tables.facts(spark, sf)
    july = (F.col("event_time") >= ts("2001-07-01")) & (F.col("event_time") < ts("2001-08-01"))
    for part in (facts, facts.filter(july)):
        profile.write_partials(spark, path, part, unit="month")
    return shown(profile.profile_90d_partials(spark, path, facts, tables.fact_labels(spark, sf), ts(WATERMARK), ts(AS_OF), unit="month"))


@query("profile_90d_approx")
def profile_90d_approx(spark, sf):
    """The default form with sketched distinct counts; rows only."""
    return shown(incremental(spark, sf, exact=False))


@query("profile_90d_approx_check", f"WITH {PROFILE} SELECT count(*) AS customers, count(*) AS close FROM ({_PROFILE_90D})")
def profile_90d_approx_check(spark, sf):
    """Sketched distinct counts are within three standard errors (5 % each), or one, of the exact ones; all else is equal."""
    exact, sketched = shown(incremental(spark, sf)), shown(incremental(spark, sf, exact=False))
    distinct = [c for c in exact.columns if "counterparty" in c]
    same = [c for c in exact.columns if c not in distinct and c != "customer_id"]
    both = exact.alias("e").join(sketched.alias("s"), "customer_id", "full")
    close = F.lit(True)
    for c in same:
        close = close & F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}"))
    for c in distinct:
        close = close & (F.abs(F.col(f"e.{c}") - F.col(f"s.{c}")) <= F.greatest(F.lit(1), F.col(f"e.{c}") * 0.15))
    return both.agg(F.count("*").alias("customers"), F.count_if(close).alias("close"))


@query("profile_90d_exact", f"WITH {PROFILE} SELECT * FROM exact")
def profile_90d_exact(spark, sf):
    return shown(exact_profiles(spark, sf))


@query(
    "profile_incremental_parity",
    """SELECT count(DISTINCT o_custkey) AS customers, CAST(0 AS BIGINT) AS only_incremental, CAST(0 AS BIGINT) AS only_full FROM orders""",
)
def profile_incremental_parity(spark, sf):
    return profile.incremental_parity(tables.facts(spark, sf), tables.fact_labels(spark, sf), ts(WATERMARK), ts(AS_OF))


@query(
    "merge_profiles",
    f"""WITH {PROFILE}, new AS ({_PROFILE_90D})
      SELECT customer_id, amount_90d, txn_cnt_90d FROM new
      UNION ALL SELECT customer_id, amount_90d, txn_cnt_90d FROM exact WHERE customer_id NOT IN (SELECT customer_id FROM affected)""",
)
def merge_profiles(spark, sf):
    """All profiles are stored, then those of the affected customers are merged in, twice; the table is read back."""
    path, updates = shared_path(spark, "profiles"), materialize(incremental(spark, sf), "profile-updates")
    profile.write_profiles(spark, path, exact_profiles(spark, sf))
    for _ in range(2):
        profile.write_profiles(spark, path, updates, updates.select("customer_id"))
    return read_latest(spark, path).select("customer_id", "amount_90d", "txn_cnt_90d")


@query(
    "profile_json_projection",
    f"""WITH {PROFILE} SELECT customer_id AS doc_id, '{{"customer_id":' || customer_id || ',"amount_90d":' || amount_90d || ',"txn_cnt_90d":' || txn_cnt_90d
      || ',"unique_counterparty_90d":' || unique_counterparty_90d || ',"recency_days":' || recency_days || ',"night_ratio":' || night_ratio
      || ',"fraud_count_90d":' || fraud_count_90d || ',"profile_as_of":"' || strftime(make_timestamp(profile_as_of_us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z"}}' AS document
      FROM exact""",
)
def profile_json_projection(spark, sf):
    """The documents as filed; filing the later half again, as a retried job would, changes nothing."""
    path, rows = shared_path(spark, "profile-documents"), exact_profiles(spark, sf)
    write_documents(spark, path, rows, "customer_id", ["profile_as_of"])
    write_documents(spark, path, rows.filter(F.col("profile_as_of") > F.lit("2001-07-01").cast("timestamp")), "customer_id", ["profile_as_of"])
    return read_latest(spark, path).select("doc_id", "document")


def _profiles_at(as_of: str, known: str) -> str:
    """Amounts and counts per customer in the 90 days up to ``as_of`` of the facts and labels that are known then."""
    return f"""SELECT c.customer_id, coalesce(CAST(sum(amount_minor) AS BIGINT), 0) AS amount_90d, count(w.txn_id) AS txn_cnt_90d,
      count(DISTINCT counterparty_id) AS unique_counterparty_90d, coalesce(CAST(sum(fraud) AS BIGINT), 0) AS fraud_count_90d
      FROM (SELECT DISTINCT customer_id FROM fact WHERE {known}) c LEFT JOIN (
        SELECT f.*, CASE WHEN l.label = 'FRAUD' THEN 1 ELSE 0 END AS fraud FROM fact f
        LEFT JOIN (SELECT * FROM fact_label WHERE {known.replace("event_time", "created_at")}) l USING (source_id, txn_id)
        WHERE {known} AND event_time >= TIMESTAMP '{as_of}' - INTERVAL 90 DAYS AND event_time < TIMESTAMP '{as_of}' + INTERVAL 1 SECOND) w
      ON w.customer_id = c.customer_id GROUP BY c.customer_id"""


@query(
    "profile_job",
    f"""WITH {FACT}, {FACT_LABEL}, {AFFECTED}, early AS ({_profiles_at(WATERMARK, f"event_time < TIMESTAMP '{WATERMARK}'")}), late AS ({_profiles_at(AS_OF, "event_time IS NOT NULL")})
      SELECT * FROM late WHERE customer_id IN (SELECT customer_id FROM affected)
      UNION ALL SELECT * FROM early WHERE customer_id NOT IN (SELECT customer_id FROM affected)""",
)
def profile_job(spark, sf):
    """Two runs of the job: everything known at the watermark, then what came later; the profiles as stored."""
    store, facts, labels = ingestion.Store(shared_path(spark, "job"), "month"), tables.facts(spark, sf), tables.fact_labels(spark, sf)
    mark = ts(WATERMARK)
    known = labels.filter(F.col("created_at") < mark)
    ingestion.ingest(spark, store, facts.filter(F.col("event_time") < mark), known, ts("1970-01-01"), mark)
    ingestion.ingest(spark, store, facts.filter(F.col("event_time") >= mark), labels, mark, ts(AS_OF))
    return read_latest(spark, store.profiles).select("customer_id", "amount_90d", "txn_cnt_90d", "unique_counterparty_90d", "fraud_count_90d")
