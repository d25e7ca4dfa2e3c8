"""Queries on event sequences, with windows and amounts wide enough for the test data."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.scan import by_weight
from ..operators import patterns
from ..session import materialize
from ..sources import tables
from .oracle import TXN
from .registry import query

PROBE, LARGE = 400_000, 4_000_000

PROBES = f"""
probe AS (
  SELECT * FROM (
    SELECT account_no, event_id AS probe_event_id, event_time AS probe_time, amount_minor AS probe_amount,
      lead(CASE WHEN amount_minor >= {LARGE} THEN event_id END IGNORE NULLS) OVER w AS large_event_id,
      lead(CASE WHEN amount_minor >= {LARGE} THEN event_time END IGNORE NULLS) OVER w AS large_time,
      lead(CASE WHEN amount_minor >= {LARGE} THEN amount_minor END IGNORE NULLS) OVER w AS large_amount
    FROM txn WINDOW w AS (PARTITION BY account_no ORDER BY event_time, event_id))
  WHERE probe_amount <= {PROBE} AND large_time - probe_time < INTERVAL 24 HOURS)"""

FAILURES = """
numbered AS (
  SELECT *, row_number() OVER w AS pos FROM txn WINDOW w AS (PARTITION BY account_no ORDER BY event_time, event_id)),
ahead AS (
  SELECT account_no, event_id AS first_event_id, event_time AS first_time, status, pos,
    lead(CASE WHEN status <> 'FAILED' THEN pos END IGNORE NULLS) OVER w - pos AS failure_count,
    lead(CASE WHEN status = 'SUCCESS' THEN event_id END IGNORE NULLS) OVER w AS success_event_id,
    lead(CASE WHEN status = 'SUCCESS' THEN event_time END IGNORE NULLS) OVER w AS success_time
  FROM numbered WINDOW w AS (PARTITION BY account_no ORDER BY pos)),
failures AS (
  SELECT account_no, first_event_id, first_time, failure_count, success_event_id, success_time, failure_count - 2 AS match_count
  FROM ahead WHERE status = 'FAILED' AND failure_count >= 3 AND success_time - first_time < INTERVAL 72 HOURS)"""

SIGNALS = """
evidence AS (
  SELECT f.account_no, f.first_event_id, string_agg(n.event_id, '|' ORDER BY n.pos) || '|' || f.success_event_id AS related
  FROM failures f JOIN ahead a ON a.account_no = f.account_no AND a.first_event_id = f.first_event_id
    JOIN numbered n ON n.account_no = f.account_no AND n.pos >= a.pos AND n.pos < a.pos + f.failure_count
  GROUP BY f.account_no, f.first_event_id, f.success_event_id),
signal AS (
  SELECT 'PROBE_THEN_LARGE' AS signal_type, account_no, large_time AS detected_at,
    probe_event_id || '|' || large_event_id AS related, 'probeAmount=' || probe_amount || ',largeAmount=' || large_amount AS attributes
  FROM probe
  UNION ALL
  SELECT 'FAILED_THEN_SUCCESS', account_no, success_time, related,
    'failureCount=' || failure_count || ',matchCount=' || match_count
  FROM failures JOIN evidence USING (account_no, first_event_id))"""


def by_account(spark, sf, scan):
    return by_weight(tables.transactions(spark, sf), "account_no", "event_time", scan)


def probes(spark, sf):
    return by_account(spark, sf, lambda txn, cuts: patterns.probe_then_large(txn, PROBE, LARGE, timedelta(hours=24), cuts))


def failures(spark, sf, least=3):
    return by_account(spark, sf, lambda txn, cuts: patterns.failed_then_success(txn, least, timedelta(hours=72), cuts=cuts))


def signals(spark, sf):
    # one scan gives all failures; those of runs long enough are the matches
    every = materialize(failures(spark, sf, 1), "failures")
    matches = every.filter(F.col("failure_count") >= 3).withColumn("match_count", F.col("failure_count") - 2)
    return patterns.signals(probes(spark, sf), patterns.run_evidence(matches, every))


@query(
    "cep_probe_then_large",
    f"WITH {TXN}, {PROBES} SELECT account_no, probe_event_id, large_event_id, probe_amount, large_amount FROM probe",
)
def cep_probe_then_large(spark, sf):
    return probes(spark, sf).select("account_no", "probe_event_id", "large_event_id", "probe_amount", "large_amount")


@query(
    "cep_failed_then_success",
    f"WITH {TXN}, {FAILURES} SELECT account_no, first_event_id, success_event_id, failure_count, match_count FROM failures",
)
def cep_failed_then_success(spark, sf):
    return failures(spark, sf).select("account_no", "first_event_id", "success_event_id", "failure_count", "match_count")


@query(
    "risk_signals",
    f"""WITH {TXN}, {PROBES}, {FAILURES}, {SIGNALS} SELECT sha256(signal_type || '|' || account_no || '|' || related) AS signal_id,
      'HIGH' AS severity, signal_type, account_no, related, attributes FROM signal""",
)
def risk_signals(spark, sf):
    attributes = F.concat_ws(",", F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return signals(spark, sf).select(
        "signal_id", "severity", "signal_type", "account_no", F.concat_ws("|", "related_event_ids").alias("related"), attributes.alias("attributes")
    )


@query(
    "risk_signal_daily",
    f"""WITH {TXN}, {PROBES}, {FAILURES}, {SIGNALS} SELECT signal_type, account_no, strftime(detected_at, '%Y-%m-%d') AS signal_date,
      count(*) AS signals FROM signal GROUP BY 1, 2, 3""",
)
def risk_signal_daily(spark, sf):
    daily = patterns.signal_summary(patterns.detections(probes(spark, sf), failures(spark, sf)))
    return daily.withColumn("signal_date", F.col("signal_date").cast("string"))
