"""Queries on rules and decisions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import decisions as dec
from ..operators import rules
from ..operators.common import latest_per
from ..session import materialize
from ..sources import tables
from .c_features import as_of
from .oracle import ASOF, CASE_LABEL, DECISIONS, FEAT, KEY, SCORE, TXN, action, hits, level
from .registry import query

_SCORED = f"{TXN}, {FEAT}, {ASOF}, {SCORE}"


def scored(spark, sf):
    return tables.fixture_score(as_of(spark, sf))


def decided(spark, sf, scorer=tables.fixture_score, asked=None, **settings):
    """Transactions (all of them unless ``asked`` names some) with their decision."""
    asked, evaluation = tables.requests(as_of(spark, sf) if asked is None else asked)
    return dec.decide(asked, KEY, scorer, **evaluation, **settings)


def records(spark, sf):
    return dec.records(decided(spark, sf))


def stored(spark, sf, *columns):
    """The decision records, or some of their columns, as a stored table, for queries that read it more than once."""
    rows = records(spark, sf)
    return materialize(rows.select(*columns) if columns else rows, "decisions")


def joined(c: str = "hit_rules"):
    return F.concat_ws(",", c).alias(c)


@query("rule_hits", f"WITH {_SCORED} SELECT event_id, {hits(tiers=False)} AS hits FROM scored")
def rule_hits(spark, sf):
    out = rules.rule_hits(scored(spark, sf), rules.RULES)
    return out.select("event_id", F.concat_ws(",", rules.codes_of(F.col("hits"))).alias("hits"))


@query(
    "decision_table_hits",
    f"""WITH {TXN} SELECT t.event_id, d.code FROM txn t JOIN (VALUES ('MOBILE', 5000000, 100000000, 'DT_MOBILE_LARGE'),
      ('MOBILE', 100000000, 9999999999, 'DT_MOBILE_HUGE'), ('WEB', 10000000, 1000000000, 'DT_WEB_LARGE')) d(channel, low, high, code)
      ON t.channel = d.channel AND t.amount_minor >= d.low AND t.amount_minor < d.high""",
)
def decision_table_hits(spark, sf):
    out = rules.rule_hits(tables.transactions(spark, sf), rules.tier_rules(rules.TIERS))
    return out.select("event_id", F.explode(rules.codes_of(F.col("hits"))).alias("code"))


_LEVELED = f"{_SCORED}, fired AS (SELECT *, {hits()} AS hits FROM scored), leveled AS (SELECT *, {level('hits')} AS risk_level FROM fired)"


def _leveled(spark, sf):
    return rules.escalate(rules.rule_hits(scored(spark, sf), dec.ALL_RULES))


@query("risk_levels", f"WITH {_LEVELED} SELECT event_id, risk_level, hits AS hit_rules FROM leveled")
def risk_levels(spark, sf):
    return _leveled(spark, sf).select("event_id", "risk_level", joined())


@query("risk_actions", f"WITH {_LEVELED} SELECT event_id, {action('risk_level')} AS action FROM leveled")
def risk_actions(spark, sf):
    return _leveled(spark, sf).select("event_id", "action")


BINDINGS = {
    "MOBILE_TRANSFER": rules.Binding(("blacklist", "threshold", "model"), "baseline-1"),
    "WEB_BANK": rules.Binding(("threshold",), "web-1"),
    "ATM_NET": rules.Binding(("blacklist", "threshold"), "atm-2", 40, ("blacklist",), "atm-1"),
}

# 31-polynomial text hashes over 32 bits, the pair combined, made signed, floored into 100 buckets
_HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split({c}, '')]), lambda a, b: (a * 31 + b) % 4294967296)"
BUCKET = f"""
hashed AS (SELECT *, ((31 + {_HASH.format(c='source_id')}) * 31 + {_HASH.format(c='txn_id')}) % 4294967296 AS h FROM scored),
bucketed AS (SELECT *, ((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 100 + 100) % 100 AS bucket FROM hashed)"""


@query(
    "decisions_by_binding",
    f"""WITH {_SCORED}, {BUCKET}, bound AS (SELECT *, CASE source_id WHEN 'MOBILE_TRANSFER' THEN 'blacklist threshold model'
        WHEN 'WEB_BANK' THEN 'threshold' WHEN 'ATM_NET' THEN CASE WHEN bucket >= 40 THEN 'blacklist' ELSE 'blacklist threshold' END ELSE '' END AS sets,
        CASE source_id WHEN 'MOBILE_TRANSFER' THEN 'baseline-1' WHEN 'WEB_BANK' THEN 'web-1'
        WHEN 'ATM_NET' THEN CASE WHEN bucket >= 40 THEN 'atm-1' ELSE 'atm-2' END ELSE 'unavailable' END AS rule_version FROM bucketed),
      fired AS (SELECT *, {hits(gate=lambda s: f"contains(sets, '{s}')")} AS hits FROM bound)
      SELECT event_id, rule_version,
        CASE WHEN sets = '' THEN 'HIGH' WHEN NOT features_available THEN 'MEDIUM' ELSE {level('hits')} END AS risk_level,
        CASE WHEN sets = '' THEN 'DEGRADED_ENGINE_UNAVAILABLE' WHEN NOT features_available THEN 'DEGRADED_FEATURE_UNAVAILABLE' ELSE hits END AS hit_rules
      FROM fired""",
)
def decisions_by_binding(spark, sf):
    out = decided(spark, sf, bindings=BINDINGS)
    return out.select("event_id", "rule_version", "risk_level", joined())


@query(
    "canary_routing",
    f"""WITH {TXN}, scored AS (SELECT * FROM txn), {BUCKET} SELECT event_id, CAST(bucket AS BIGINT) AS bucket,
      CASE WHEN bucket >= 30 THEN 'v1' ELSE 'v2' END AS version FROM bucketed""",
)
def canary_routing(spark, sf):
    out = rules.canary(tables.transactions(spark, sf), 30, "v2", "v1")
    return out.select("event_id", F.col("bucket").cast("bigint").alias("bucket"), "version")


@query(
    "shadow_diff",
    f"""WITH {_SCORED}, fired AS (SELECT *, {hits()} AS active_hits, {hits(large=3_000_000)} AS shadow_hits FROM scored),
      leveled AS (SELECT event_id, {level('active_hits')} AS active_level, {level('shadow_hits')} AS shadow_level, active_hits, shadow_hits FROM fired)
      SELECT * FROM leveled WHERE active_level <> shadow_level OR active_hits <> shadow_hits""",
)
def shadow_diff(spark, sf):
    stricter = [
        replace(r, predicate=r.predicate.replace("5000000", "3000000")) if r.code == "LARGE_TRANSFER" else r for r in dec.ALL_RULES
    ]
    out = rules.shadow_diff(scored(spark, sf), dec.ALL_RULES, stricter)
    return out.select("event_id", "active_level", "shadow_level", joined("active_hits"), joined("shadow_hits"))


_RECORD = "decision_id, source_id, txn_id, account_token, risk_level, action, fraud_score, hit_rules, rule_version, model_version, cost_ms"


@query(
    "decisions_degraded",
    f"WITH {DECISIONS} SELECT {_RECORD} FROM decision WHERE hit_rules LIKE 'DEGRADED%'",
)
def decisions_degraded(spark, sf):
    out = records(spark, sf).filter(F.exists("hit_rules", lambda c: c.startswith("DEGRADED_")))
    return out.withColumn("hit_rules", joined()).select(*_RECORD.split(", "))


_SNAPSHOT = """CASE WHEN features_available AND feature_event_time IS NOT NULL THEN concat_ws(',',
  'daily_stat_date=' || strftime(daily_stat_date, '%Y%m%d'), 'daily_amount=' || daily_amount, 'daily_count=' || daily_count, 'txn_count_5m=' || txn_count,
  'device_new=' || device_new, 'known_device_count=' || known_device_count, 'unique_counterparty_count=' || unique_counterparty_count,
  'feature_event_time=' || (epoch_us(feature_event_time) // 1000)) ELSE '' END AS feature_snapshot"""


@query(
    "decisions",
    f"""WITH {DECISIONS}, day AS (SELECT event_id, lag(daily_stat_date) OVER (PARTITION BY account_no ORDER BY event_time, event_id) AS daily_stat_date FROM feat)
      SELECT {_RECORD}, 'c-' || d.txn_id AS correlation_id, epoch_us(created_at) AS created_us, epoch_us(d.event_time) AS event_us, {_SNAPSHOT}
      FROM decision d JOIN (SELECT n, event_id, features_available, daily_amount, daily_count, txn_count, device_new, known_device_count,
        unique_counterparty_count, feature_event_time FROM stored) s USING (n) JOIN day USING (event_id)""",
)
def decisions(spark, sf):
    pairs = F.transform(F.map_entries("feature_snapshot"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return records(spark, sf).withColumns({"hit_rules": joined(), "feature_snapshot": F.concat_ws(",", pairs)}).select(
        *_RECORD.split(", "),
        "correlation_id",
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("event_time").alias("event_us"),
        "feature_snapshot",
    )


@query("decisions_idempotent", f"WITH {DECISIONS} SELECT {_RECORD} FROM decision")
def decisions_idempotent(spark, sf):
    """Retried requests, a minute later and at another cost, leave the first decision in place."""
    first = stored(spark, sf)
    retried = first.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 MINUTE")).withColumn("cost_ms", F.col("cost_ms") + 1)
    out = dec.idempotent(first.unionByName(retried))
    return out.withColumn("hit_rules", joined()).select(*_RECORD.split(", "))


@query(
    "outbox_events",
    f"""WITH {DECISIONS}, t(topic, kind) AS (VALUES ('transaction.v1', 'Transaction'), ('decision.v1', 'Decision'))
      SELECT sha256(decision_id || '|' || topic) AS event_id, kind AS aggregate_type,
        CASE kind WHEN 'Decision' THEN decision_id ELSE txn_id END AS aggregate_id, topic, account_no AS message_key,
        CASE kind WHEN 'Decision' THEN CASE risk_level WHEN 'REJECT' THEN 'CRITICAL' ELSE risk_level END ELSE '' END AS risk_level,
        CASE kind WHEN 'Decision' THEN hit_rules ELSE '' END AS hit_rules
      FROM decision CROSS JOIN t""",
)
def outbox_events(spark, sf):
    codes = F.from_json(F.get_json_object("payload", "$.hitRules"), "array<struct<ruleCode:string>>")["ruleCode"]
    return dec.outbox(decided(spark, sf)).select(
        "event_id", "aggregate_type", "aggregate_id", "topic", "message_key",
        F.coalesce(F.get_json_object("payload", "$.riskLevel"), F.lit("")).alias("risk_level"),
        F.concat_ws(",", codes).alias("hit_rules"),
    )


@query(
    "opened_cases",
    f"""WITH {DECISIONS} SELECT sha256(decision_id || '|case') AS case_id, decision_id, risk_level, 'OPEN' AS status,
      CAST(0 AS BIGINT) AS version FROM decision WHERE action IN ('REVIEW', 'CHALLENGE')""",
)
def opened_cases(spark, sf):
    return dec.open_cases(records(spark, sf)).select("case_id", "decision_id", "risk_level", "status", "version")


@query(
    "rule_effectiveness",
    f"""WITH {DECISIONS}, {CASE_LABEL}, h AS (SELECT source_id, txn_id, unnest(string_split(hit_rules, ',')) AS rule FROM decision WHERE hit_rules <> '')
      SELECT rule, count(*) AS hits, count(*) / (SELECT count(*) FROM decision) AS hit_ratio, count(label) AS labelled,
        CASE WHEN count(label) > 0 THEN count(*) FILTER (WHERE label = 'FRAUD') / count(label) ELSE 0.0::DOUBLE END AS fraud_rate
      FROM h LEFT JOIN case_label USING (source_id, txn_id) GROUP BY rule""",
)
def rule_effectiveness(spark, sf):
    return dec.rule_effect(records(spark, sf), tables.case_labels(spark, sf))


@query(
    "intercepts_30d",
    f"""WITH {DECISIONS} SELECT account_token, count(*) AS intercepts FROM decision
      WHERE created_at <= TIMESTAMP '2024-02-05 00:00:00' AND created_at > TIMESTAMP '2024-01-06 00:00:00' AND action = 'REJECT' GROUP BY 1""",
)
def intercepts_30d(spark, sf):
    return dec.intercepts(records(spark, sf), F.lit("2024-02-05 00:00:00").cast("timestamp"))


def reissued(first):
    """Stored decisions as delivered: every one twice, the second a minute later at twice the cost."""
    again = first.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 MINUTE")).withColumn("cost_ms", F.col("cost_ms") * 2)
    return first.unionByName(again)


@query("decision_projection_latest", f"WITH {DECISIONS} SELECT decision_id, risk_level, cost_ms * 2 AS cost_ms FROM decision")
def decision_projection_latest(spark, sf):
    return latest_per(reissued(stored(spark, sf)), ["decision_id"], ["created_at", "cost_ms"]).select("decision_id", "risk_level", "cost_ms")
