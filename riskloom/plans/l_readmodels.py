"""Queries of the operations views."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import decisions as dec
from ..operators import readmodels as views
from ..session import materialize
from ..sources import tables
from ..sources.contracts import dead_letters, parse_transactions, validate_contract
from .e_decisions import decided, joined, records, stored
from .g_profile import ts
from .oracle import DECISIONS
from .registry import query

NOW = "2024-02-01 00:00:00"


def us(c):
    return F.unix_micros(c).alias(f"{c}_us")


@query(
    "decision_search",
    f"""WITH {DECISIONS}, f AS (SELECT * FROM decision WHERE risk_level = 'HIGH')
      SELECT decision_id, txn_id, risk_level, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, decision_id LIMIT 50 OFFSET 50""",
)
def decision_search(spark, sf):
    return views.search_decisions(stored(spark, sf), level="HIGH", page=1, size=50).select("decision_id", "txn_id", "risk_level", "total")


@query(
    "case_queue",
    f"""WITH {DECISIONS} SELECT sha256(decision_id || '|case') AS case_id, decision_id, risk_level, 'OPEN' AS status FROM decision
      WHERE action IN ('REVIEW', 'CHALLENGE') ORDER BY created_at DESC, case_id LIMIT 200""",
)
def case_queue(spark, sf):
    return views.case_queue(dec.open_cases(records(spark, sf)), "OPEN").select("case_id", "decision_id", "risk_level", "status")


def _outbox_state(decisions):
    """Delivery state of the outbox: messages of rejected decisions are dead, costly ones wait for a retry."""
    keys = decisions.select("decision_id", "created_at", "action", "cost_ms")
    topics = F.explode(F.array(F.lit("transaction.v1"), F.lit("decision.v1"))).alias("topic")
    status = F.when(F.col("action") == "REJECT", "DEAD").when(F.col("cost_ms") >= 60, "PENDING").otherwise("PUBLISHED")
    return keys.select("*", topics).select(
        F.sha2(F.concat_ws("|", "decision_id", "topic"), 256).alias("event_id"),
        "topic",
        status.alias("status"),
        F.when(F.col("action") == "REJECT", 10).otherwise(0).cast("bigint").alias("attempts"),
        F.when(F.col("action") == "REJECT", "delivery failed").alias("last_error"),
        "created_at",
        (F.col("created_at") + F.make_dt_interval(mins=F.col("cost_ms").cast("int"))).alias("next_attempt_at"),
    )


OUTBOX_SQL = """
outbox AS (
  SELECT sha256(decision_id || '|' || topic) AS event_id, topic, created_at, created_at + to_minutes(CAST(cost_ms AS INTEGER)) AS next_attempt_at,
    CASE WHEN action = 'REJECT' THEN 'DEAD' WHEN cost_ms >= 60 THEN 'PENDING' ELSE 'PUBLISHED' END AS status
  FROM decision, (VALUES ('transaction.v1'), ('decision.v1')) t(topic))"""


def _dead_letters(spark, sf):
    txn = tables.transactions(spark, sf)
    messages = tables.envelopes(txn).withColumn("created_at", ts(NOW))
    _, rejected = validate_contract(parse_transactions(messages))
    return dead_letters(rejected).withColumn("created_at", ts(NOW))


@query(
    "dead_events",
    f"""WITH {DECISIONS}, {OUTBOX_SQL} SELECT event_id, 'OUTBOX' AS event_kind, topic, CAST(10 AS BIGINT) AS attempts, 'delivery failed' AS last_error
      FROM outbox WHERE status = 'DEAD'
      UNION ALL SELECT 'dlt-transaction.v1.DLT-' || (n % 4) || '-' || (n // 4), 'KAFKA_DLT', 'transaction.v1', 0, 'rejected by the contract'
      FROM txn WHERE n % 97 = 0 OR amount_minor <= 0""",
)
def dead_events(spark, sf):
    return views.dead_events(_outbox_state(records(spark, sf)), _dead_letters(spark, sf)).drop("created_at")


@query(
    "outbox_backlog",
    f"""WITH {DECISIONS}, {OUTBOX_SQL} SELECT topic, count(*) FILTER (WHERE status = 'PENDING') AS pending,
      count(*) FILTER (WHERE status = 'PENDING' AND next_attempt_at <= TIMESTAMP '2024-01-30 00:00:00') AS due,
      count(*) FILTER (WHERE status = 'DEAD') AS dead,
      epoch_us(TIMESTAMP '2024-01-30 00:00:00') // 1000000 - epoch_us(min(created_at) FILTER (WHERE status = 'PENDING')) // 1000000 AS oldest_seconds
      FROM outbox GROUP BY topic""",
)
def outbox_backlog(spark, sf):
    return views.outbox_backlog(_outbox_state(records(spark, sf)), ts("2024-01-30 00:00:00"))


@query(
    "status_counts",
    f"""WITH {DECISIONS}, {OUTBOX_SQL} SELECT 'outbox' AS kind, status, count(*) AS n FROM outbox GROUP BY status
      UNION ALL SELECT 'order', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus""",
)
def status_counts(spark, sf):
    orders = tables.table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status")
    return views.status_counts(_outbox_state(records(spark, sf)), "outbox").unionByName(views.status_counts(orders, "order"))


@query(
    "risk_overview",
    f"""WITH {DECISIONS}, {OUTBOX_SQL}, top AS (SELECT * FROM decision ORDER BY created_at DESC, decision_id LIMIT 100),
      c AS (SELECT count(*) AS shown, count(*) FILTER (WHERE risk_level = 'LOW') AS low, count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium,
        count(*) FILTER (WHERE risk_level = 'HIGH') AS high, count(*) FILTER (WHERE risk_level = 'REJECT') AS reject FROM top)
      SELECT *, high + reject AS high_risk, CAST(round((high + reject) / shown * 100) AS BIGINT) AS high_risk_percent,
        (SELECT count(*) FROM decision WHERE action IN ('REVIEW', 'CHALLENGE')) AS open_cases,
        (SELECT count(*) FROM decision) AS total, (SELECT count(*) FROM outbox WHERE status = 'DEAD') AS dead_events FROM c""",
)
def risk_overview(spark, sf):
    decisions = stored(spark, sf)
    dead = _outbox_state(decisions).filter(F.col("status") == "DEAD")
    return views.overview(decisions, dec.open_cases(decisions), dead)


@query(
    "high_risk_decisions",
    f"WITH {DECISIONS} SELECT decision_id, risk_level, hit_rules FROM decision WHERE risk_level IN ('HIGH', 'REJECT')",
)
def high_risk_decisions(spark, sf):
    return views.high_risk_decisions(records(spark, sf)).select("decision_id", "risk_level", joined())


_WINDOW = "epoch_us(time_bucket(INTERVAL 1 HOUR, created_at)) AS window_start_us"


@query(
    "latency_quantiles",
    f"""WITH {DECISIONS} SELECT {_WINDOW}, count(*) AS decisions, quantile_cont(cost_ms, 0.99) AS p99_ms, quantile_cont(cost_ms, 0.999) AS p999_ms
      FROM decision GROUP BY 1""",
)
def latency_quantiles(spark, sf):
    out = views.latency_quantiles(records(spark, sf), "1 hour")
    return out.select(us("window_start"), "decisions", "p99_ms", "p999_ms")


@query(
    "latency_sketch_check",
    f"""WITH {DECISIONS}, w AS (SELECT {_WINDOW} FROM decision GROUP BY 1) SELECT count(*) AS windows, count(*) AS p50_close, count(*) AS p99_close, count(*) AS p999_close FROM w""",
)
def latency_sketch_check(spark, sf):
    """Sketches of five minutes rolled up to hours: every quantile is within one percent of the exact lower one."""
    rows, probabilities = materialize(records(spark, sf).select("created_at", "cost_ms"), "latencies"), (0.5, 0.99, 0.999)
    hours = views.sketch_quantiles(views.rolled_up(views.latency_sketch(rows), "1 hour"), probabilities)
    start = F.window("created_at", "1 hour")["start"].alias("window_start")
    names = {p: views.percent_name(p) for p in probabilities}
    exact = rows.groupBy(start).agg(F.sort_array(F.collect_list("cost_ms")).alias("v")).select(
        "window_start", *[F.element_at("v", F.greatest(F.ceil(F.size("v") * p), F.lit(1)).cast("int")).alias(n) for p, n in names.items()]
    )
    both = hours.join(exact, "window_start")
    close = [F.count_if(F.abs(F.col(f"{n}_ms") - F.col(n)) <= F.col(n) * 0.01 + 1e-9).alias(f"{n}_close") for n in names.values()]
    return both.agg(F.count("*").alias("windows"), *close)


@query(
    "latency_alerts",
    f"""WITH {DECISIONS}, q AS (SELECT {_WINDOW}, quantile_cont(cost_ms, 0.99) AS p99_ms, quantile_cont(cost_ms, 0.999) AS p999_ms FROM decision GROUP BY 1)
      SELECT *, count(*) FILTER (WHERE p99_ms > 50) OVER w >= 3 AS p99_alert, count(*) FILTER (WHERE p999_ms > 100) OVER w >= 3 AS p999_alert
      FROM q WINDOW w AS (ORDER BY window_start_us RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW)""",
)
def latency_alerts(spark, sf):
    """The test data are sparse, so windows are hours and an alert has to hold for two."""
    hours = views.latency_quantiles(records(spark, sf), "1 hour")
    out = views.latency_alerts(hours, timedelta(hours=1), timedelta(hours=2))
    return out.select(us("window_start"), "p99_ms", "p999_ms", "p99_alert", "p999_alert")


@query(
    "decision_rates",
    f"WITH {DECISIONS} SELECT {_WINDOW}, risk_level, action, hit_rules LIKE 'DEGRADED%' AS degraded, count(*) AS decisions FROM decision GROUP BY 1, 2, 3, 4",
)
def decision_rates(spark, sf):
    return views.decision_rates(records(spark, sf), "1 hour").select(us("window_start"), "risk_level", "action", "degraded", "decisions")


@query(
    "rule_hit_ratio",
    f"WITH {DECISIONS} SELECT {_WINDOW}, count(*) AS decisions, avg(CASE WHEN hit_rules <> '' THEN 1 ELSE 0 END) AS hit_ratio FROM decision GROUP BY 1",
)
def rule_hit_ratio(spark, sf):
    return views.rule_hit_ratio(records(spark, sf), "1 hour").select(us("window_start"), "decisions", "hit_ratio")


@query(
    "score_quantiles",
    f"WITH {DECISIONS} SELECT quantile_disc(fraud_score, 0.5) AS p50, quantile_disc(fraud_score, 0.95) AS p95 FROM decision",
)
def score_quantiles(spark, sf):
    return views.quantiles(records(spark, sf), "fraud_score", (0.5, 0.95))


@query("score_quantiles_approx")
def score_quantiles_approx(spark, sf):
    return views.approx_quantiles(records(spark, sf), "fraud_score", (0.5, 0.95))


@query("score_quantiles_approx_check", "SELECT true AS p50_close, true AS p95_close")
def score_quantiles_approx_check(spark, sf):
    """The sketch is within a hundredth of the exact quantiles."""
    rows, p = stored(spark, sf), (0.5, 0.95)
    both = views.quantiles(rows, "fraud_score", p).unionByName(views.approx_quantiles(rows, "fraud_score", p))
    return both.agg(*[(F.max(c) - F.min(c) <= 0.01).alias(f"{c}_close") for c in ("p50", "p95")])


@query(
    "decision_replay",
    f"""WITH {DECISIONS}, r AS (SELECT *, sha256(sha256(decision_id || '|decision.v1') || '|' || '{NOW}') AS event_id FROM decision WHERE risk_level = 'REJECT')
      SELECT event_id, decision_id AS aggregate_id, account_no AS message_key, event_id AS payload_event_id,
        '2024-02-01T00:00:00.000000Z' AS payload_time, decision_id AS payload_decision FROM r""",
)
def decision_replay(spark, sf):
    rows = materialize(decided(spark, sf), "decided")
    wanted = rows.filter(F.col("risk_level") == "REJECT").select("decision_id")
    out = views.replay(dec.outbox(rows), wanted, ts(NOW))
    return out.select(
        "event_id", "aggregate_id", "message_key",
        F.get_json_object("payload", "$.metadata.eventId").alias("payload_event_id"),
        F.get_json_object("payload", "$.metadata.occurredAt").alias("payload_time"),
        F.get_json_object("payload", "$.decisionId").alias("payload_decision"),
    )


@query(
    "account_investigation",
    f"""WITH {DECISIONS} SELECT account_token, count(*) AS txn_count, CAST(sum(amount_minor) AS BIGINT) AS amount_minor,
      count(*) FILTER (WHERE action = 'REJECT') AS rejected, count(*) FILTER (WHERE amount_minor < 100000) AS range_0,
      count(*) FILTER (WHERE amount_minor >= 100000 AND amount_minor < 1000000) AS range_1,
      count(*) FILTER (WHERE amount_minor >= 1000000 AND amount_minor < 5000000) AS range_2,
      count(*) FILTER (WHERE amount_minor >= 5000000) AS range_3
      FROM decision JOIN (SELECT source_id, txn_id, amount_minor FROM txn) USING (source_id, txn_id) GROUP BY 1""",
)
def account_investigation(spark, sf):
    return views.account_investigation(records(spark, sf), tables.transactions(spark, sf))
