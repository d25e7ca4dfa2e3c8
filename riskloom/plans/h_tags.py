"""Queries on customer tags and account groups."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.scan import by_weight
from ..operators import graph, tags
from ..operators.features import latest_features
from ..sources import tables
from ..sources.schemas import CHANNELS
from .c_features import snapshot
from .g_profile import AS_OF, exact_profiles, ts
from .g_profile import PROFILE as PROFILE_SQL
from .oracle import CASE_LABEL, FACT, FEAT, TXN
from .registry import query

TXN_AS_OF = "2024-01-31 00:00:00"

_RECENT = f"event_time <= TIMESTAMP '{AS_OF}' AND event_time > TIMESTAMP '{AS_OF}' - INTERVAL"
RFM_SQL = f"""
rfm AS (
  SELECT customer_id,
    CASE WHEN count(*) FILTER (WHERE {_RECENT} 30 DAYS) > 0 THEN sum(amount_minor) FILTER (WHERE {_RECENT} 30 DAYS)
      / count(*) FILTER (WHERE {_RECENT} 30 DAYS) ELSE 0.0 END::DOUBLE AS avg_amount_30d,
    CAST(sum(amount_minor) AS BIGINT) AS total_amount_90d, max(amount_minor) AS max_amount_90d,
    count(*) FILTER (WHERE {_RECENT} 30 DAYS) AS frequency_30d,
    CAST(coalesce(sum(amount_minor) FILTER (WHERE {_RECENT} 30 DAYS), 0) AS BIGINT) AS monetary_30d,
    CAST(date_diff('day', max(event_time), TIMESTAMP '{AS_OF}') AS BIGINT) AS recency_days
  FROM fact WHERE {_RECENT} 90 DAYS GROUP BY customer_id)"""


def rfm(spark, sf):
    return tags.rfm(tables.facts(spark, sf), "customer_id", ts(AS_OF))


@query("tags_rfm", f"WITH {FACT}, {RFM_SQL} SELECT * FROM rfm")
def tags_rfm(spark, sf):
    return rfm(spark, sf).withColumn("recency_days", F.col("recency_days").cast("bigint"))


@query(
    "tags_value_tier",
    f"""WITH {FACT}, {RFM_SQL} SELECT customer_id, CASE WHEN total_amount_90d >= 50000000 THEN 'HIGH'
      WHEN total_amount_90d >= 20000000 THEN 'MIDDLE' ELSE 'LOW' END AS value_tier FROM rfm""",
)
def tags_value_tier(spark, sf):
    return tags.value_tier(rfm(spark, sf), "customer_id")


TOP_SQL = """
tops AS (
  SELECT account_no, max(CASE WHEN dim = 'b' THEN v END) AS top_biz_type, max(CASE WHEN dim = 'c' THEN v END) AS top_channel FROM (
    SELECT account_no, dim, v, row_number() OVER (PARTITION BY account_no, dim ORDER BY count(*) DESC, v) AS rn FROM (
      SELECT account_no, 'b' AS dim, biz_type AS v FROM txn UNION ALL SELECT account_no, 'c', channel FROM txn)
    GROUP BY account_no, dim, v) WHERE rn = 1 GROUP BY account_no)"""


@query("tags_top_category", f"WITH {TXN}, {TOP_SQL} SELECT * FROM tops")
def tags_top_category(spark, sf):
    return tags.top_categories(tables.transactions(spark, sf), "account_no", ["biz_type", "channel"])


@query(
    "tags_active_hour",
    f"""WITH {TXN}, p AS (SELECT account_no, CASE WHEN hour(event_time) < 6 THEN 1 WHEN hour(event_time) < 12 THEN 2
        WHEN hour(event_time) < 18 THEN 3 ELSE 4 END AS part FROM txn),
      r AS (SELECT account_no, part, row_number() OVER (PARTITION BY account_no ORDER BY count(*) DESC, part) AS rn FROM p GROUP BY 1, 2)
      SELECT account_no, CASE part WHEN 1 THEN 'NIGHT' WHEN 2 THEN 'MORNING' WHEN 3 THEN 'AFTERNOON' ELSE 'EVENING' END AS active_hour_pref
      FROM r WHERE rn = 1""",
)
def tags_active_hour(spark, sf):
    return tags.active_hour(tables.transactions(spark, sf), "account_no")


@query(
    "tags_night_ratio",
    f"WITH {TXN} SELECT account_no, avg(CASE WHEN hour(event_time) < 6 THEN 1 ELSE 0 END) AS night_txn_ratio FROM txn GROUP BY 1",
)
def tags_night_ratio(spark, sf):
    return tags.night_ratio(tables.transactions(spark, sf), "account_no")


@query(
    "tags_rfm_segment",
    f"""WITH {FACT}, s AS (SELECT customer_id, date_diff('day', max(event_time), TIMESTAMP '{AS_OF}') AS r,
        date_diff('day', min(event_time), TIMESTAMP '{AS_OF}') AS age, count(*) FILTER (WHERE {_RECENT} 365 DAYS) AS f,
        coalesce(sum(amount_minor) FILTER (WHERE {_RECENT} 365 DAYS), 0) AS m
        FROM fact WHERE event_time <= TIMESTAMP '{AS_OF}' GROUP BY 1)
      SELECT customer_id, CASE WHEN age <= 180 THEN 'NEW' WHEN r <= 60 AND f >= 3 AND m >= 100000000 THEN 'HIGH_VALUE_ACTIVE'
          WHEN r <= 60 THEN 'ACTIVE' WHEN r <= 365 THEN 'DORMANT' ELSE 'CHURN_WARNING' END AS rfm_segment,
        CASE WHEN r > 365 THEN 'LOST' WHEN r > 60 THEN 'DECLINE' WHEN age <= 180 THEN 'NEW' WHEN age <= 720 THEN 'GROWTH' ELSE 'MATURE' END
          AS lifecycle_stage FROM s""",
)
def tags_rfm_segment(spark, sf):
    return tags.segments(tables.facts(spark, sf), "customer_id", ts(AS_OF))


@query(
    "tags_device_count",
    f"""WITH {TXN} SELECT account_no, count(DISTINCT device_id) AS device_count_90d FROM txn
      WHERE event_time <= TIMESTAMP '{TXN_AS_OF}' GROUP BY 1""",
)
def tags_device_count(spark, sf):
    return tags.device_count(tables.transactions(spark, sf), "account_no", ts(TXN_AS_OF))


@query(
    "tags_amount_volatility",
    f"""WITH {TXN} SELECT account_no, round(stddev_pop(amount_minor::DOUBLE) / avg(amount_minor::DOUBLE), 6) AS amount_volatility
      FROM txn GROUP BY 1""",
)
def tags_amount_volatility(spark, sf):
    out = tags.amount_volatility(tables.transactions(spark, sf), "account_no")
    return out.withColumn("amount_volatility", F.round("amount_volatility", 6))


@query(
    "tags_counterparty_concentration",
    f"""WITH {TXN}, s AS (SELECT account_no, counterparty, sum(amount_minor) AS s,
        row_number() OVER (PARTITION BY account_no ORDER BY sum(amount_minor) DESC, counterparty) AS rn
        FROM txn WHERE counterparty IS NOT NULL GROUP BY 1, 2)
      SELECT account_no, sum(s) FILTER (WHERE rn <= 3)::DOUBLE / sum(s)::DOUBLE AS counterparty_concentration FROM s GROUP BY 1""",
)
def tags_counterparty_concentration(spark, sf):
    return tags.counterparty_concentration(tables.transactions(spark, sf), "account_no")


@query(
    "tags_ratios",
    f"""WITH {TXN} SELECT account_no, avg(CASE WHEN counterparty IS NOT NULL THEN 1 ELSE 0 END) AS cross_bank_ratio,
      avg(CASE WHEN amount_minor % 10000 = 0 THEN 1 ELSE 0 END) AS round_amount_ratio FROM txn GROUP BY 1""",
)
def tags_ratios(spark, sf):
    return tags.ratios(tables.transactions(spark, sf), "account_no")


FLOW_SQL = """
flow AS (
  SELECT account_no AS account, event_time, event_id, -amount_minor AS amount FROM txn
  UNION ALL SELECT counterparty, event_time, event_id, amount_minor FROM txn WHERE counterparty IN (SELECT account_no FROM txn))"""


@query(
    "tags_net_flow",
    f"""WITH {TXN}, {FLOW_SQL} SELECT account, CAST(coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS BIGINT) AS inflow,
      CAST(-sum(amount) FILTER (WHERE amount < 0) AS BIGINT) AS outflow, CAST(sum(amount) AS BIGINT) AS net_fund_flow
      FROM flow GROUP BY 1""",
)
def tags_net_flow(spark, sf):
    return tags.net_flow(tables.flows(tables.transactions(spark, sf)))


@query(
    "tags_fast_in_out",
    f"""WITH {TXN}, {FLOW_SQL}, o AS (SELECT account, amount, event_time - max(CASE WHEN amount > 0 THEN event_time END)
        OVER (PARTITION BY account ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) <= INTERVAL 2 HOURS AS fast FROM flow)
      SELECT account, coalesce(sum(-amount) FILTER (WHERE fast), 0)::DOUBLE / sum(-amount)::DOUBLE AS fast_in_out_ratio
      FROM o WHERE amount < 0 GROUP BY 1""",
)
def tags_fast_in_out(spark, sf):
    flows = tables.flows(tables.transactions(spark, sf))
    return by_weight(flows, "account", "event_time", lambda rows, cuts: tags.fast_in_out(rows, within=timedelta(hours=2), cuts=cuts))


@query(
    "tags_ip_change",
    f"""WITH {TXN}, p AS (SELECT event_id, account_no, event_time, string_split(ip, '.')[1] || '.' || string_split(ip, '.')[2] AS prefix FROM txn)
      SELECT event_id, coalesce(prefix <> lag(prefix) OVER (PARTITION BY account_no ORDER BY event_time, event_id), false) AS geo_anomaly FROM p""",
)
def tags_ip_change(spark, sf):
    txn = tables.transactions(spark, sf).select("event_id", "account_no", "event_time", "ip")
    changes = by_weight(txn, "account_no", "event_time", lambda rows, cuts: tags.network_change(rows, "account_no", cuts))
    return changes.select("event_id", "geo_anomaly")


GROUPS_SQL = """
edge AS (SELECT DISTINCT account_no, device_id FROM txn),
reach(account_no, other) AS (
  SELECT account_no, account_no FROM edge
  UNION
  SELECT r.account_no, b.account_no FROM reach r JOIN edge a ON a.account_no = r.other JOIN edge b ON b.device_id = a.device_id),
grp AS (SELECT account_no, min(other) AS group_id FROM reach GROUP BY 1)"""


def groups(spark, sf):
    return graph.shared_device_groups(tables.transactions(spark, sf))


@query("graph_shared_device_groups", f"WITH RECURSIVE {TXN}, {GROUPS_SQL} SELECT * FROM grp")
def graph_shared_device_groups(spark, sf):
    return groups(spark, sf)


@query(
    "graph_gang_risk",
    f"""WITH RECURSIVE {TXN}, {GROUPS_SQL}, {CASE_LABEL}, a AS (SELECT account_no, count(*) AS labelled,
        count(*) FILTER (WHERE label = 'FRAUD') AS frauds FROM txn JOIN case_label USING (source_id, txn_id) GROUP BY 1)
      SELECT group_id, count(*) AS accounts, CAST(coalesce(sum(labelled), 0) AS BIGINT) AS labelled, CAST(coalesce(sum(frauds), 0) AS BIGINT) AS frauds,
        count(*) >= 2 AND coalesce(sum(labelled), 0) > 0 AND coalesce(sum(frauds), 0) >= 0.05 * coalesce(sum(labelled), 0) AS gang_risk_flag
      FROM grp LEFT JOIN a USING (account_no) GROUP BY 1""",
)
def graph_gang_risk(spark, sf):
    return graph.gang_risk(groups(spark, sf), tables.transactions(spark, sf), tables.case_labels(spark, sf))


@query(
    "graph_fund_role",
    f"""WITH {TXN}, e AS (SELECT DISTINCT account_no, counterparty FROM txn WHERE counterparty IS NOT NULL),
      d AS (SELECT account, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (
        SELECT account_no AS account, 0 AS i, 1 AS o FROM e UNION ALL SELECT counterparty, 1, 0 FROM e) GROUP BY 1)
      SELECT *, CASE WHEN in_degree >= 20 AND out_degree >= 20 THEN 'RELAY' WHEN in_degree >= 50 THEN 'COLLECTOR'
        WHEN out_degree >= 50 THEN 'DISTRIBUTOR' ELSE 'ORDINARY' END AS fund_role FROM d""",
)
def graph_fund_role(spark, sf):
    return graph.fund_role(tables.transactions(spark, sf))


@query(
    "graph_two_hop",
    f"""WITH {TXN}, edge AS (SELECT DISTINCT account_no, device_id FROM txn),
      seed AS (SELECT DISTINCT account_no FROM txn WHERE blacklist),
      one AS (SELECT DISTINCT b.account_no FROM seed JOIN edge a USING (account_no) JOIN edge b USING (device_id) WHERE b.account_no NOT IN (FROM seed)),
      known AS (FROM seed UNION FROM one),
      two AS (SELECT DISTINCT b.account_no FROM one JOIN edge a USING (account_no) JOIN edge b USING (device_id) WHERE b.account_no NOT IN (FROM known))
      SELECT account_no, 1 AS hops FROM one UNION ALL SELECT account_no, 2 FROM two""",
)
def graph_two_hop(spark, sf):
    txn = tables.transactions(spark, sf)
    return graph.linked_within(graph.device_edges(txn), txn.filter("blacklist").select("account_no"))


@query(
    "tags_trend",
    f"""WITH {TXN}, g AS (SELECT *, epoch_us(event_time) // 1000000 - lag(epoch_us(event_time) // 1000000)
        OVER (PARTITION BY account_no ORDER BY event_time, event_id) AS gap,
        event_time <= TIMESTAMP '{TXN_AS_OF}' AND event_time > TIMESTAMP '{TXN_AS_OF}' - INTERVAL 7 DAYS AS cur,
        event_time <= TIMESTAMP '{TXN_AS_OF}' - INTERVAL 7 DAYS AND event_time > TIMESTAMP '{TXN_AS_OF}' - INTERVAL 14 DAYS AS prev,
        date_diff('day', event_time, TIMESTAMP '{TXN_AS_OF}') AS age FROM txn),
      s AS (SELECT account_no, coalesce(avg(gap), 0.0) AS avg_gap_seconds, coalesce(max(gap), 0) AS max_gap_seconds,
        round(coalesce(regr_slope(amount_minor / 100.0::DOUBLE, (-age)::DOUBLE), 0.0), 4) AS amount_slope,
        CAST(coalesce(sum(amount_minor) FILTER (WHERE cur), 0) AS BIGINT) AS current_amount,
        CAST(coalesce(sum(amount_minor) FILTER (WHERE prev), 0) AS BIGINT) AS previous_amount FROM g GROUP BY 1)
      SELECT *, CASE WHEN previous_amount > 0 THEN (current_amount - previous_amount) / previous_amount ELSE 0.0::DOUBLE END AS growth FROM s""",
)
def tags_trend(spark, sf):
    txn = tables.transactions(spark, sf).select("event_id", "account_no", "event_time", "amount_minor")
    trends = by_weight(txn, "account_no", "event_time", lambda rows, cuts: tags.trend(rows, "account_no", ts(TXN_AS_OF), cuts=cuts))
    return trends.withColumn("amount_slope", F.round("amount_slope", 4))


@query(
    "tags_zscore",
    f"""WITH {PROFILE_SQL}, v AS (SELECT c_custkey AS customer_id, amount_90d::DOUBLE AS x FROM customer LEFT JOIN exact ON c_custkey = exact.customer_id),
      s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM v)
      SELECT customer_id, round(coalesce(x, m), 2) AS filled, round(greatest(-3.0, least(3.0, (coalesce(x, m) - m) / sd)), 6) AS z_score FROM v, s""",
)
def tags_zscore(spark, sf):
    customers = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"))
    amounts = customers.join(exact_profiles(spark, sf).select("customer_id", "amount_90d"), "customer_id", "left")
    return tags.z_scores(amounts, "customer_id", "amount_90d").select(
        "customer_id", F.round("filled", 2).alias("filled"), F.round("z_score", 6).alias("z_score")
    )


@query(
    "tags_encoded",
    f"""WITH {TXN}, {TOP_SQL} SELECT account_no, CASE top_channel WHEN 'MOBILE' THEN 0 WHEN 'WEB' THEN 1 WHEN 'ATM' THEN 2 WHEN 'API' THEN 3 ELSE 4 END::BIGINT
      AS top_channel_index, (top_channel = 'MOBILE')::BIGINT AS is_mobile, (top_channel = 'WEB')::BIGINT AS is_web, (top_channel = 'ATM')::BIGINT AS is_atm,
      (top_channel = 'API')::BIGINT AS is_api, (top_channel = 'BRANCH')::BIGINT AS is_branch FROM tops""",
)
def tags_encoded(spark, sf):
    top = tags.top_categories(tables.transactions(spark, sf), "account_no", ["channel"])
    return tags.encoded(top, "account_no", "top_channel", CHANNELS)


@query("tags_clusters")
def tags_clusters(spark, sf):
    columns = ["total_amount_90d", "max_amount_90d", "frequency_30d", "recency_days"]
    return tags.clusters(rfm(spark, sf), "customer_id", columns)


@query("tags_clusters_check", f"WITH {FACT}, {RFM_SQL} SELECT count(*) AS members, count(*) AS customers, true AS named FROM rfm")
def tags_clusters_check(spark, sf):
    """Every customer is in one of four clusters."""
    return tags_clusters(spark, sf).agg(
        F.count("*").alias("members"), F.count_distinct("customer_id").alias("customers"), F.every(F.col("cluster").between(0, 3)).alias("named")
    )


@query(
    "tags_stale",
    f"""WITH {TXN}, {FEAT}, l AS (SELECT account_no, max(event_time) AS t FROM feat GROUP BY 1),
      d(tag_id, fresh) AS (VALUES ('daily_amount', 21600), ('daily_count', 43200), ('known_device_count', 86400))
      SELECT account_no, tag_id, epoch_us(TIMESTAMP '{TXN_AS_OF}') // 1000000 - epoch_us(t) // 1000000 AS age_seconds FROM l CROSS JOIN d
      WHERE epoch_us(TIMESTAMP '{TXN_AS_OF}') // 1000000 - epoch_us(t) // 1000000 > fresh""",
)
def tags_stale(spark, sf):
    definitions = spark.createDataFrame(
        [("daily_amount", 21_600), ("daily_count", 43_200), ("known_device_count", 86_400)], "tag_id string, freshness_seconds bigint"
    )
    values = latest_features(snapshot(spark, sf)).select("account_no", "feature_event_time", "daily_amount", "daily_count", "known_device_count")
    return tags.stale_tags(values, "account_no", "feature_event_time", definitions, ts(TXN_AS_OF))
