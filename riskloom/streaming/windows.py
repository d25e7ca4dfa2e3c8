"""Windowed totals and de-duplication over streams, with built-in operators only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import LATENESS


def deduplicated(txn: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The first arrival of each event id; ids are remembered as long as lateness allows."""
    return txn.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["event_id"])


def decision_metrics(
    decisions: DataFrame, window: str = "5 minutes", slide: str = "1 minute", lateness: str = LATENESS
) -> DataFrame:
    """Decisions per sliding window, level and action, with mean latency and hit share."""
    return (
        decisions.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", window, slide), "risk_level", "action")
        .agg(
            F.count(F.lit(1)).alias("decisions"),
            F.sum("cost_ms").alias("cost_ms"),
            F.sum((F.size("hit_rules") > 0).cast("bigint")).alias("with_hits"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "risk_level", "action", "decisions", "cost_ms", "with_hits")
    )


def tumbling_totals(txn: DataFrame, window: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Amount and count per account and window."""
    return (
        txn.withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", window), "account_no")
        .agg(F.sum("amount_minor").alias("amount_minor"), F.count(F.lit(1)).alias("txn_count"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "account_no", "amount_minor", "txn_count")
    )


def session_totals(txn: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Amount and count per account and session: events less than or just ``gap`` apart belong together.

    A session ends ``gap`` after its last event and is given out once the watermark has passed its end. An event
    behind the watermark is dropped, unless it falls into a session that is still open.
    """
    return (
        txn.withWatermark("event_time", lateness)
        .groupBy(F.session_window("event_time", gap), "account_no")
        .agg(F.sum("amount_minor").alias("amount_minor"), F.count(F.lit(1)).alias("txn_count"))
        .select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "account_no", "amount_minor", "txn_count")
    )
