"""Queries on reading, validating and filing events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators.common import latest_per
from ..session import shared_path
from ..sources import tables
from ..sources.changes import current_state, increment, retention_tier
from ..sources.contracts import (
    contract_reasons,
    dead_letters,
    event_time_reason,
    parse_transactions,
    request_reasons,
    validate_contract,
)
from ..sources.sinks import read_daily_partitions, write_daily_partitions
from .oracle import FACT, TXN
from .registry import query


def micros(c):
    return F.unix_micros(F.col(c))


@query(
    "txn_envelope_flatten",
    f"""WITH {TXN} SELECT event_id, 'c-' || txn_id AS correlation_id, source_id, txn_id, CAST(1 AS INTEGER) AS schema_version,
      epoch_us(event_time) AS occurred_us, channel, biz_type, account_no, counterparty, amount_minor, currency, device_id, ip,
      epoch_us(event_time) AS event_us, status FROM txn WHERE n % 97 <> 0""",
)
def txn_envelope_flatten(spark, sf):
    parsed = parse_transactions(tables.envelopes(tables.transactions(spark, sf)))
    return parsed.filter(~F.col("malformed")).select(
        "event_id", "correlation_id", "source_id", "txn_id", "schema_version", micros("occurred_at").alias("occurred_us"),
        "channel", "biz_type", "account_no", "counterparty", "amount_minor", "currency", "device_id", "ip",
        micros("event_time").alias("event_us"), "status",
    )


@query(
    "contract_violations",
    f"""WITH {TXN}, checked AS (SELECT n % 4 AS part, n // 4 AS off,
        CASE WHEN n % 97 = 0 THEN 'malformed' WHEN amount_minor <= 0 THEN 'amount_minor must be positive' END AS violations FROM txn)
      SELECT CAST(part AS BIGINT) AS "partition", off AS "offset", violations FROM checked WHERE violations IS NOT NULL""",
)
def contract_violations(spark, sf):
    parsed = parse_transactions(tables.envelopes(tables.transactions(spark, sf)))
    _, rejected = validate_contract(parsed)
    return rejected.select(
        F.col("partition").cast("bigint").alias("partition"), "offset", F.concat_ws("; ", "violations").alias("violations")
    )


@query(
    "request_violations",
    f"""WITH {TXN}, req AS (SELECT t.n, CASE event_type WHEN 'view' THEN 'MOBILE' WHEN 'click' THEN 'WEB' ELSE upper(event_type) END AS channel,
        CASE WHEN k < 5 THEN 'cny' ELSE 'CNY' END AS currency,
        CASE WHEN k > 95 THEN repeat(account_no, 5) ELSE account_no END AS account_no, amount_minor
        FROM txn t JOIN raw ON raw.n = t.n),
      checked AS (SELECT 't-' || n AS txn_id, concat_ws(',',
        CASE WHEN length(account_no) > 64 THEN 'account_no' END,
        CASE WHEN channel NOT IN ('MOBILE','WEB','ATM','API','BRANCH') THEN 'channel' END,
        CASE WHEN currency = 'cny' THEN 'currency' END,
        CASE WHEN amount_minor <= 0 THEN 'amount_minor' END) AS violations FROM req)
      SELECT * FROM checked WHERE violations <> ''""",
)
def request_violations(spark, sf):
    events = tables.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    raw = events.select(F.col("event_id").alias("n"), "event_type", k.alias("k"))
    kind = F.col("event_type")
    requests = tables.transactions_from_events(events).drop("channel", "currency").join(raw, "n").select(
        "source_id", "txn_id", "biz_type", "amount_minor", "counterparty", "device_id",
        F.when(kind == "view", "MOBILE").when(kind == "click", "WEB").otherwise(F.upper(kind)).alias("channel"),
        F.when(F.col("k") < 5, "cny").otherwise("CNY").alias("currency"),
        F.when(F.col("k") > 95, F.repeat("account_no", F.lit(5))).otherwise(F.col("account_no")).alias("account_no"),
    )
    checked = request_reasons(requests).filter(F.size("violations") > 0)
    return checked.select("txn_id", F.concat_ws(",", "violations").alias("violations"))


@query(
    "event_time_violations",
    f"""WITH {TXN}, t AS (SELECT event_id, CASE WHEN event_time < TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 20 DAYS THEN 'TOO_OLD'
        WHEN event_time > TIMESTAMP '2024-01-25 00:05:00' THEN 'IN_FUTURE' END AS time_violation FROM txn)
      SELECT * FROM t WHERE time_violation IS NOT NULL""",
)
def event_time_violations(spark, sf):
    now = F.lit("2024-01-25 00:00:00").cast("timestamp")
    checked = event_time_reason(tables.transactions(spark, sf), now, max_age=timedelta(days=20))
    return checked.filter(F.col("time_violation").isNotNull()).select("event_id", "time_violation")


@query(
    "dead_letter_catalog",
    f"""WITH {TXN} SELECT 'dlt-transaction.v1.DLT-' || (n % 4) || '-' || (n // 4) AS event_id, 'transaction.v1.DLT' AS dlt_topic,
      'transaction.v1' AS original_topic, CAST(n % 4 AS BIGINT) AS partition_no, n // 4 AS source_offset, account_no AS message_key,
      'DEAD' AS status, CAST(0 AS BIGINT) AS attempts FROM txn WHERE n % 97 = 0 OR amount_minor <= 0""",
)
def dead_letter_catalog(spark, sf):
    _, rejected = validate_contract(parse_transactions(tables.envelopes(tables.transactions(spark, sf))))
    return latest_per(dead_letters(rejected), ["event_id"], ["source_offset"]).select(
        "event_id", "dlt_topic", "original_topic", F.col("partition_no").cast("bigint").alias("partition_no"),
        "source_offset", "message_key", "status", "attempts",
    )


@query(
    "cdc_latest_state",
    f"""WITH {TXN}, c AS (SELECT *, CASE status WHEN 'FAILED' THEN 'd' WHEN 'SUCCESS' THEN 'u' ELSE 'c' END AS op FROM txn),
      r AS (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY event_time DESC, n DESC) AS rn FROM c)
      SELECT account_no, amount_minor, device_id, op AS __op, 'payment' AS __table, epoch_us(event_time) // 1000 AS __source_ts_ms,
        op = 'd' AS __deleted FROM r WHERE rn = 1""",
)
def cdc_latest_state(spark, sf):
    row = F.struct("account_no", "amount_minor", "device_id")
    op = F.when(F.col("status") == "FAILED", "d").when(F.col("status") == "SUCCESS", "u").otherwise("c")
    changes = tables.transactions(spark, sf).select(
        F.when(op != "c", row).alias("before"),
        F.when(op != "d", row).alias("after"),
        op.alias("op"),
        F.struct(F.lit("payment").alias("table"), F.unix_millis("event_time").alias("ts_ms"), F.col("n").alias("pos")).alias("source"),
    )
    return current_state(changes, ["account_no"]).drop("__source_pos")


@query(
    "fact_increment",
    f"""WITH {FACT} SELECT txn_id, customer_id, amount_minor, epoch_us(event_time) AS event_us FROM fact
      WHERE event_time >= TIMESTAMP '2001-07-01 00:00:00'""",
)
def fact_increment(spark, sf):
    fresh = increment(tables.facts(spark, sf), "event_time", F.lit("2001-07-01 00:00:00").cast("timestamp"))
    return fresh.select("txn_id", "customer_id", "amount_minor", micros("event_time").alias("event_us"))


@query(
    "txn_daily_index",
    f"""WITH {TXN} SELECT strftime(event_time, '%Y-%m-%d') AS event_date, count(*) AS txn_count,
      CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM txn GROUP BY 1""",
)
def txn_daily_index(spark, sf):
    """Written by day, the last day again as a repeated delivery would; read back and counted."""
    path, txn = shared_path(spark, "daily"), tables.transactions(spark, sf)
    write_daily_partitions(txn, path, ["event_id", "amount_minor"])
    last = txn.agg(F.max(F.to_date("event_time"))).first()[0]
    write_daily_partitions(txn.filter(F.to_date("event_time") == F.lit(last)), path, ["event_id", "amount_minor"])
    days = read_daily_partitions(spark, path).groupBy(F.col("event_date").cast("string").alias("event_date"))
    return days.agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount_minor").alias("amount_minor"))


@query(
    "decision_retention_tier",
    f"""WITH {FACT} SELECT txn_id, CASE WHEN event_time <= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 180 DAYS THEN 'deleted'
      WHEN event_time <= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 7 DAYS THEN 'warm' ELSE 'hot' END AS tier FROM fact""",
)
def decision_retention_tier(spark, sf):
    now = F.lit("2001-08-02 00:00:00").cast("timestamp")
    return retention_tier(tables.facts(spark, sf), "event_time", now).select("txn_id", "tier")
