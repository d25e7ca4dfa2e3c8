"""Queries on pseudonymising and masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import privacy
from ..sources import tables
from .oracle import FACT, KEY, TXN, hmac
from .registry import query


@query("account_tokens", f"WITH {TXN} SELECT event_id, {hmac('account_no')} AS account_token, {hmac('counterparty')} AS counterparty_token FROM txn")
def account_tokens(spark, sf):
    txn = privacy.tokenize(tables.transactions(spark, sf), "account_no", KEY, "account_token")
    return privacy.tokenize(txn, "counterparty", KEY, "counterparty_token").select("event_id", "account_token", "counterparty_token")


def _mask(c: str) -> str:
    return f"CASE WHEN length({c}) > 10 THEN left({c}, 6) || repeat('*', length({c}) - 10) || right({c}, 4) ELSE {c} END"


@query(
    "masked_transactions",
    f"""WITH {TXN} SELECT event_id, {_mask('account_no')} AS account_masked, {_mask('counterparty')} AS counterparty_masked,
      '****' || right(account_no, 4) AS account_tail, amount_minor, amount_minor / 100.0::DOUBLE AS amount_yuan FROM txn""",
)
def masked_transactions(spark, sf):
    return privacy.masked(tables.transactions(spark, sf))


@query(
    "fact_transactions",
    f"""WITH {TXN} SELECT source_id, txn_id, {hmac('account_no')} AS customer_id, {hmac('counterparty')} AS counterparty_id,
      amount_minor, epoch_us(event_time) AS event_us FROM txn""",
)
def fact_transactions(spark, sf):
    txn = tables.transactions(spark, sf)
    decisions = privacy.tokenize(txn, "account_no", KEY, "account_token").select("source_id", "txn_id", "account_token")
    facts = privacy.privacy_facts(txn, decisions, KEY)
    return facts.withColumn("event_us", F.unix_micros("event_time")).drop("event_time")


@query(
    "pii_leak_scan",
    f"""WITH {TXN}, o AS (SELECT {_mask('account_no')} AS account_masked, '****' || right(account_no, 4) AS account_tail,
        {hmac('account_no')} AS account_token, counterparty FROM txn),
      l AS (SELECT 'account_masked' AS "column", account_masked AS v FROM o UNION ALL SELECT 'account_tail', account_tail FROM o
        UNION ALL SELECT 'account_token', account_token FROM o UNION ALL SELECT 'counterparty', counterparty FROM o)
      SELECT "column", count(*) FILTER (WHERE v IN (SELECT account_no FROM txn)) AS leaked_rows FROM l GROUP BY 1""",
)
def pii_leak_scan(spark, sf):
    txn = tables.transactions(spark, sf)
    columns = ["account_masked", "account_tail", "account_token", "counterparty"]
    outputs = txn.select(
        privacy.mask_middle(F.col("account_no")).alias("account_masked"),
        privacy.mask_tail(F.col("account_no")).alias("account_tail"),
        privacy.hmac_sha256(F.col("account_no"), KEY).alias("account_token"),
        "counterparty",
    )
    return privacy.leak_scan(outputs, columns, txn.select("account_no"))


@query(
    "txn_enriched",
    f"""WITH {FACT} SELECT txn_id, customer_id, amount_minor, n_name AS nation, r_name AS region FROM fact
      LEFT JOIN customer ON c_custkey = customer_id LEFT JOIN nation ON n_nationkey = c_nationkey
      LEFT JOIN region ON r_regionkey = n_regionkey""",
)
def txn_enriched(spark, sf):
    out = privacy.enrich_region(
        tables.facts(spark, sf), tables.table(spark, sf, "customer"), tables.table(spark, sf, "nation"), tables.table(spark, sf, "region")
    )
    return out.select("txn_id", "customer_id", "amount_minor", "nation", "region")
