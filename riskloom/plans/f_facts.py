"""Queries on fact merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts
from ..session import shared_path
from ..sources import tables
from ..sources.versioned import read_version
from .e_decisions import records
from .oracle import CASE_LABEL, DECISIONS, FACT, TXN
from .registry import query


@query(
    "merge_immutable",
    f"""WITH {FACT} SELECT txn_id, customer_id, CASE WHEN event_time >= TIMESTAMP '2001-01-01 00:00:00' THEN amount_minor + 1 ELSE amount_minor END AS amount_minor
      FROM fact""",
)
def merge_immutable(spark, sf):
    """Facts of 2001 arrive again, corrected by one unit; the first part of them is already stored. Written by year, merged, read back."""
    fact = tables.facts(spark, sf).select("source_id", "txn_id", "customer_id", "amount_minor", "event_time")
    stored = fact.filter(F.col("event_time") < F.lit("2001-04-01").cast("timestamp"))
    incoming = fact.filter(F.col("event_time") >= F.lit("2001-01-01").cast("timestamp")).withColumn("amount_minor", F.col("amount_minor") + 1)
    path, year = shared_path(spark, "facts"), F.year("event_time")
    for part in (stored, incoming):
        facts.write_merged(spark, path, part.withColumn("event_year", year), facts.KEYS, "event_year")
    return read_version(spark, path).select("txn_id", "customer_id", "amount_minor")


@query(
    "fact_decision_features",
    f"""WITH {DECISIONS} SELECT s.source_id, s.txn_id, amount_minor / 100.0::DOUBLE AS amount,
      coalesce(CASE WHEN features_available THEN daily_amount END / 100.0::DOUBLE, -1.0) AS daily_amount,
      coalesce(CAST(CASE WHEN features_available THEN daily_count END AS DOUBLE), -1.0) AS daily_count,
      CAST(hour(s.event_time) AS DOUBLE) AS hour,
      CASE WHEN counterparty IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cross_bank,
      CASE WHEN features_available AND device_new THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS device_new
      FROM stored s""",
)
def fact_decision_features(spark, sf):
    stored = records(spark, sf).withColumn("feature_snapshot_json", F.to_json("feature_snapshot"))
    out = facts.decision_features(tables.transactions(spark, sf), stored)
    return out.fillna(-1.0, ["daily_amount", "daily_count"])


@query("fact_labels", f"WITH {TXN}, {CASE_LABEL} SELECT source_id, txn_id, label, epoch_us(created_at) AS created_us FROM case_label")
def fact_labels(spark, sf):
    decided = records(spark, sf)
    feedback = tables.case_labels(spark, sf).select(
        F.sha2(F.concat_ws("|", "source_id", "txn_id"), 256).alias("decision_id"), "label", "created_at"
    )
    out = facts.label_facts(feedback, decided)
    return out.withColumn("created_us", F.unix_micros("created_at")).drop("created_at")
