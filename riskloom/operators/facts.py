"""Facts for training and profiling, and merges of immutable increments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.versioned import PART, part_name, parts_of, read_version, replace_parts, version
from .features import model_columns

KEYS = ["source_id", "txn_id"]


#: How a decision keeps its features: a JSON object of texts.
SNAPSHOT = "daily_amount string, daily_count string, device_new string"


def merge_replace(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key is not among the incoming ones, plus all incoming rows."""
    kept = target.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming)


def write_merged(spark: SparkSession, target: str, incoming: DataFrame, keys: Sequence[str], partition: str) -> None:
    """Merge an increment into a versioned table with a part per value of ``partition``, nulls included.

    Rows whose key comes again are replaced. Touched are the parts of the incoming rows and those that hold an
    incoming key so far, so a key that moved leaves its old part; only these are read as a whole and written
    anew. The merged table appears in one step: a failure before it leaves the table as it was.
    """
    incoming = materialize(incoming, "merge-increment")
    base = version(spark, target)
    rows = incoming.withColumn(PART, part_name(F.col(partition)))
    touched = set(parts_of(rows))
    current = read_version(spark, target, base)
    if current is not None:
        held = current.join(incoming.select(*keys), list(keys), "left_semi")
        touched |= set(parts_of(held.select(part_name(F.col(partition)).alias(PART))))
        merged = merge_replace(read_version(spark, target, base, sorted(touched)), incoming.select(*current.columns), keys)
        rows = merged.withColumn(PART, part_name(F.col(partition)))
    replace_parts(rows, target, base, sorted(touched))


def decision_features(txn: DataFrame, decisions: DataFrame) -> DataFrame:
    """Model features per decided transaction, as stored with the decision rather than as they are now."""
    stored = decisions.select(*KEYS, F.from_json("feature_snapshot_json", SNAPSHOT).alias("s")).select(
        *KEYS,
        F.col("s.daily_amount").cast("bigint").alias("daily_amount"),
        F.col("s.daily_count").cast("bigint").alias("daily_count"),
        F.col("s.device_new").cast("boolean").alias("device_new"),
    )
    return txn.select(*KEYS, "amount_minor", "counterparty", "event_time").join(stored, KEYS).select(*KEYS, *model_columns())


def label_facts(feedback: DataFrame, decisions: DataFrame) -> DataFrame:
    """Analyst feedback by decision id, resolved to the transaction's key."""
    keys = decisions.select("decision_id", *KEYS)
    return feedback.join(keys, "decision_id").select(*KEYS, "label", "created_at")
