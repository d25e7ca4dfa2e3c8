"""Pseudonymising, masking, and checking that no raw account leaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import salted_join
from ..functions.text import hmac_sha256, mask_middle, mask_tail


def tokenize(df: DataFrame, col: str, key: str, out: str = "token") -> DataFrame:
    return df.withColumn(out, hmac_sha256(F.col(col), key))


def minor_to_major(c: Column) -> Column:
    return c / F.lit(100.0)


def masked(txn: DataFrame) -> DataFrame:
    """Searchable transaction rows: masked identifiers, amounts in major units, no raw account."""
    return txn.select(
        "event_id",
        mask_middle(F.col("account_no")).alias("account_masked"),
        mask_middle(F.col("counterparty")).alias("counterparty_masked"),
        mask_tail(F.col("account_no")).alias("account_tail"),
        "amount_minor",
        minor_to_major(F.col("amount_minor")).alias("amount_yuan"),
    )


def privacy_facts(txn: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Transaction facts under the decision's account token; device and raw ids are dropped."""
    tokens = decisions.select("source_id", "txn_id", F.col("account_token").alias("customer_id"))
    return txn.join(tokens, ["source_id", "txn_id"]).select(
        "source_id",
        "txn_id",
        "customer_id",
        hmac_sha256(F.col("counterparty"), key).alias("counterparty_id"),
        "amount_minor",
        "event_time",
    )


def leak_scan(outputs: DataFrame, columns: Sequence[str], raw_values: DataFrame) -> DataFrame:
    """Rows per output column in which a raw value survives. ``raw_values`` has one column.

    Values are counted before they are compared, so a frequent value travels once.
    """
    raw = raw_values.toDF("value").distinct()
    long = outputs.unpivot([], [F.col(c).cast("string").alias(c) for c in columns], "column", "value")
    hits = (
        long.filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
        .join(raw, "value", "left_semi")
        .groupBy("column")
        .agg(F.sum("rows").alias("leaked_rows"))
    )
    names = outputs.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(hits, "column", "left").select("column", F.coalesce("leaked_rows", F.lit(0)).cast("bigint").alias("leaked_rows"))


def enrich_region(facts: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Add nation and region names. A customer with very many facts is spread over salts."""
    dim = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    )
    return salted_join(facts, dim, ["customer_id"], ["source_id", "txn_id"], "left")
