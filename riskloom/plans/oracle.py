"""Shared table expressions of the check SQL, written for DuckDB over the raw tables."""

from __future__ import annotations

KEY = "demo-hmac-key"

TXN = """
raw AS (
  SELECT event_id AS n, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
  FROM events),
txn AS (
  SELECT n, 'e-' || n AS event_id, 't-' || n AS txn_id,
    CASE n % 4 WHEN 0 THEN 'MOBILE_TRANSFER' WHEN 1 THEN 'WEB_BANK' WHEN 2 THEN 'ATM_NET' ELSE 'API_PARTNER' END AS source_id,
    CASE n % 5 WHEN 0 THEN 'MOBILE' WHEN 1 THEN 'WEB' WHEN 2 THEN 'ATM' WHEN 3 THEN 'API' ELSE 'BRANCH' END AS channel,
    CASE (n // 4) % 4 WHEN 0 THEN 'TRANSFER' WHEN 1 THEN 'REMITTANCE' WHEN 2 THEN 'PAYMENT' ELSE 'WITHDRAWAL' END AS biz_type,
    '6225' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS account_no,
    CASE WHEN k % 10 <> 0 AND k <> user_id THEN '6225' || lpad(CAST(k AS VARCHAR), 12, '0') END AS counterparty,
    CAST(round(value * 100) AS BIGINT) * 400 AS amount_minor,
    'd-' || (user_id // 3) || '-' || (k % 2) AS device_id,
    '10.' || (n % 3) || '.' || (user_id % 256) || '.1' AS ip,
    CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCESS' ELSE 'UNKNOWN' END AS status,
    ts AS event_time, 'CNY' AS currency,
    user_id % 50 = 7 AS blacklist, n % 101 <> 0 AS features_available,
    ('d-' || (user_id // 3) || '-' || (k % 2)) = 'd-3-1' AS device_blacklist
  FROM raw)"""

ISO = "strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"

FACT = """
fact AS (
  SELECT 'ORD' AS source_id, CAST(o_orderkey AS VARCHAR) AS txn_id, o_custkey AS customer_id,
         's-' || s.supp AS counterparty_id, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS event_time
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS supp FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey)"""

CASE_LABEL = """
case_label AS (
  SELECT t.source_id, t.txn_id, CASE WHEN l.toxic = 1 THEN 'FRAUD' ELSE 'NORMAL' END AS label,
         t.event_time + INTERVAL 1 HOUR AS created_at
  FROM labels l JOIN txn t ON t.n = l.doc_id)"""

FACT_LABEL = """
fact_label AS (
  SELECT 'ORD' AS source_id, CAST(o_orderkey AS VARCHAR) AS txn_id,
         CASE WHEN l.toxic = 1 THEN 'FRAUD' ELSE 'NORMAL' END AS label,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER) + 1) AS created_at
  FROM labels l JOIN orders ON o_orderkey = l.doc_id)"""


def hmac(column: str, key: str = KEY) -> str:
    raw = key.encode().ljust(64, b"\0")
    inner = "".join(f"\\x{b ^ 0x36:02X}" for b in raw)
    outer = "".join(f"\\x{b ^ 0x5C:02X}" for b in raw)
    return (
        f"CASE WHEN trim({column}) <> '' THEN "
        f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode({column})))) END"
    )


# Running account features, one row per transaction; velocity over 24 hours.
FEAT = """
first_seen AS (
  SELECT *, row_number() OVER (PARTITION BY account_no, device_id ORDER BY event_time, event_id) = 1 AS device_new,
         counterparty IS NOT NULL
           AND row_number() OVER (PARTITION BY account_no, counterparty ORDER BY event_time, event_id) = 1 AS cp_new
  FROM txn),
feat AS (
  SELECT *,
    CAST(event_time AS DATE) AS daily_stat_date,
    CAST(sum(amount_minor) OVER day AS BIGINT) AS daily_amount, count(*) OVER day AS daily_count,
    count(*) OVER (PARTITION BY account_no ORDER BY event_time RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS txn_count,
    CAST(sum(CAST(device_new AS INTEGER)) OVER acc AS BIGINT) AS known_device_count,
    CAST(sum(CAST(cp_new AS INTEGER)) OVER acc AS BIGINT) AS unique_counterparty_count,
    max(event_time) OVER acc AS feature_event_time
  FROM first_seen
  WINDOW day AS (PARTITION BY account_no, CAST(event_time AS DATE) ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING),
         acc AS (PARTITION BY account_no ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING))"""

# The values stored by the account's previous transaction.
ASOF = """
stored AS (
  SELECT n, event_id, txn_id, source_id, channel, biz_type, account_no, counterparty, amount_minor, device_id, ip, status,
         event_time, currency, blacklist, device_blacklist, features_available,
    lag(daily_amount) OVER w AS daily_amount, lag(daily_count) OVER w AS daily_count, lag(txn_count) OVER w AS txn_count,
    lag(device_new) OVER w AS device_new, lag(known_device_count) OVER w AS known_device_count,
    lag(unique_counterparty_count) OVER w AS unique_counterparty_count, lag(feature_event_time) OVER w AS feature_event_time
  FROM feat WINDOW w AS (PARTITION BY account_no ORDER BY event_time, event_id))"""


# The decision of every transaction: all rules and tiers, three bound sources.
SCORE = """
scored AS (
  SELECT *, round(1.0 / (1.0 + exp(-(-3.0::DOUBLE + amount_minor / 100.0::DOUBLE * 0.00002 + coalesce(daily_amount, 0) / 100.0::DOUBLE * 0.000015
    + CASE WHEN device_new THEN 1.2 ELSE 0 END + CASE WHEN counterparty IS NOT NULL THEN 0.6 ELSE 0 END
    + CASE WHEN hour(event_time) < 6 THEN 1 ELSE 0 END + coalesce(daily_count, 0) * 0.05))), 6) AS raw_score
  FROM stored)"""


def hits(score: str = "raw_score", gate=lambda rule_set: "true", large: int = 5_000_000, tiers: bool = True) -> str:
    """Sorted comma-joined list of fired rules."""
    rules = [
        ("BLACKLIST_ACCOUNT", "blacklist", "blacklist"),
        ("BLACKLIST_DEVICE", "blacklist", "device_blacklist"),
        ("DAILY_AMOUNT_EXCEEDED", "threshold", "daily_amount > 10000000"),
        ("DT_MOBILE_HUGE", "threshold", "channel = 'MOBILE' AND amount_minor >= 100000000 AND amount_minor < 9999999999"),
        ("DT_MOBILE_LARGE", "threshold", "channel = 'MOBILE' AND amount_minor >= 5000000 AND amount_minor < 100000000"),
        ("DT_WEB_LARGE", "threshold", "channel = 'WEB' AND amount_minor >= 10000000 AND amount_minor < 1000000000"),
        ("HIGH_VELOCITY", "threshold", "txn_count >= 5"),
        ("LARGE_TRANSFER", "threshold", f"biz_type = 'TRANSFER' AND amount_minor > {large}"),
        ("MODEL_HIGH_RISK", "model", f"{score} > 0.9"),
        ("MODEL_MID_RISK", "model", f"{score} > 0.6 AND {score} <= 0.9"),
        ("NEW_DEVICE_MID_AMOUNT", "threshold", "amount_minor > 1000000 AND device_new"),
    ]
    lines = [f"CASE WHEN {p} AND {gate(s)} THEN '{c}' END" for c, s, p in rules if tiers or not c.startswith("DT_")]
    return "concat_ws(',', " + ", ".join(lines) + ")"


def level(hits: str) -> str:
    return (
        f"CASE WHEN {hits} LIKE '%BLACKLIST%' OR {hits} LIKE '%MODEL_HIGH%' THEN 'REJECT' "
        f"WHEN {hits} IN ('', 'NEW_DEVICE_MID_AMOUNT') THEN CASE WHEN {hits} = '' THEN 'LOW' ELSE 'MEDIUM' END ELSE 'HIGH' END"
    )


def action(level: str) -> str:
    return f"CASE {level} WHEN 'LOW' THEN 'ALLOW' WHEN 'MEDIUM' THEN 'CHALLENGE' WHEN 'HIGH' THEN 'REVIEW' ELSE 'REJECT' END"


DECISION = f"""
fired AS (SELECT *, {hits()} AS all_hits FROM scored),
graded AS (
  SELECT *, CASE WHEN source_id = 'API_PARTNER' THEN 'HIGH' WHEN NOT features_available THEN 'MEDIUM' ELSE {level("all_hits")} END AS risk_level
  FROM fired),
decision AS (
  SELECT sha256(source_id || '|' || txn_id) AS decision_id, n, source_id, txn_id, account_no, event_time, event_time AS created_at,
    {hmac("account_no")} AS account_token, risk_level, {action("risk_level")} AS action,
    CASE WHEN source_id = 'API_PARTNER' OR NOT features_available THEN 0.0::DOUBLE ELSE raw_score END AS fraud_score,
    CASE WHEN source_id = 'API_PARTNER' THEN 'DEGRADED_ENGINE_UNAVAILABLE' WHEN NOT features_available THEN 'DEGRADED_FEATURE_UNAVAILABLE'
      ELSE all_hits END AS hit_rules,
    CASE WHEN source_id = 'API_PARTNER' THEN 'unavailable' ELSE 'baseline-1' END AS rule_version,
    CASE WHEN source_id = 'API_PARTNER' THEN 'unavailable' WHEN NOT features_available THEN 'not-evaluated' ELSE 'fraud-1' END AS model_version,
    n % 120 AS cost_ms
  FROM graded)"""

DECISIONS = f"{TXN}, {FEAT}, {ASOF}, {SCORE}, {DECISION}"
