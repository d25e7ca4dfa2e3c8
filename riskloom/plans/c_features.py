"""Queries on account features."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.scan import by_weight
from ..operators import features
from ..operators.snapshots import window_counts
from ..sources import tables
from .oracle import ASOF, FEAT, TXN
from .registry import query

# wider than the default so that the sparse test data has something to count
WIDE = timedelta(hours=24)


def snapshot(spark, sf):
    return features.feature_snapshot(tables.transactions(spark, sf), window=WIDE)


def as_of(spark, sf):
    return features.features_before(tables.transactions(spark, sf), window=WIDE)


def _shown(df):
    return df.withColumn("daily_stat_date", F.col("daily_stat_date").cast("string")).withColumn(
        "feature_event_us", F.unix_micros("feature_event_time")
    ).drop("feature_event_time")


@query(
    "dedup_events",
    f"""WITH {TXN}, sent AS (SELECT * FROM txn UNION ALL SELECT * FROM txn WHERE status = 'FAILED')
      SELECT event_id, min(account_no) AS account_no, min(amount_minor) AS amount_minor FROM sent GROUP BY event_id""",
)
def dedup_events(spark, sf):
    txn = tables.transactions(spark, sf)
    resent = txn.filter(F.col("status") == "FAILED")
    return features.dedupe_events(txn.unionByName(resent)).select("event_id", "account_no", "amount_minor")


@query("feat_daily_running", f"WITH {TXN}, {FEAT} SELECT event_id, daily_amount, daily_count FROM feat")
def feat_daily_running(spark, sf):
    out = by_weight(tables.transactions(spark, sf), "account_no", "event_time", lambda txn, cuts: features.daily_running(txn, cuts=cuts))
    return out.select("event_id", "daily_amount", "daily_count")


@query(
    "feat_velocity",
    f"""WITH {TXN} SELECT event_id, count(*) OVER (PARTITION BY account_no ORDER BY event_time
      RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW) AS txn_count_5m,
      count(*) OVER (PARTITION BY account_no ORDER BY event_time
      RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS txn_count_24h FROM txn""",
)
def feat_velocity(spark, sf):
    txn = tables.transactions(spark, sf).select("event_id", "account_no", "event_time")
    both = window_counts(txn, {"txn_count_5m": features.VELOCITY, "txn_count_24h": WIDE})
    return both.select("event_id", "txn_count_5m", "txn_count_24h")


@query("feat_device_new", f"WITH {TXN}, {FEAT} SELECT event_id, device_new FROM feat")
def feat_device_new(spark, sf):
    txn = tables.transactions(spark, sf).select("event_id", "account_no", "device_id", "event_time")
    return features.device_new(txn).select("event_id", "device_new")


@query("feat_known_devices", f"WITH {TXN}, {FEAT} SELECT event_id, known_device_count FROM feat")
def feat_known_devices(spark, sf):
    txn = tables.transactions(spark, sf).select("event_id", "account_no", "device_id", "event_time")
    return by_weight(txn, "account_no", "event_time", lambda rows, cuts: features.distinct_running(rows, "device_id", "known_device_count", cuts)).select("event_id", "known_device_count")


@query("feat_unique_counterparties", f"WITH {TXN}, {FEAT} SELECT event_id, unique_counterparty_count FROM feat")
def feat_unique_counterparties(spark, sf):
    txn = tables.transactions(spark, sf).select("event_id", "account_no", "counterparty", "event_time")
    out = by_weight(txn, "account_no", "event_time", lambda rows, cuts: features.distinct_running(rows, "counterparty", "unique_counterparty_count", cuts))
    return out.select("event_id", "unique_counterparty_count")


_SHOWN = """account_no, strftime(daily_stat_date, '%Y-%m-%d') AS daily_stat_date, daily_amount, daily_count, txn_count, device_new,
  known_device_count, unique_counterparty_count, epoch_us(feature_event_time) AS feature_event_us"""


@query("feat_snapshot", f"WITH {TXN}, {FEAT} SELECT event_id, {_SHOWN} FROM feat")
def feat_snapshot(spark, sf):
    return _shown(snapshot(spark, sf)).select(
        "event_id", "account_no", "daily_stat_date", "daily_amount", "daily_count", "txn_count", "device_new",
        "known_device_count", "unique_counterparty_count", "feature_event_us",
    )


@query(
    "feat_latest",
    f"""WITH {TXN}, {FEAT}, r AS (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY event_time DESC, event_id DESC) AS rn FROM feat)
      SELECT {_SHOWN} FROM r WHERE rn = 1""",
)
def feat_latest(spark, sf):
    return _shown(features.latest_features(snapshot(spark, sf)))


@query(
    "feat_point_in_time",
    f"""WITH {TXN}, {FEAT}, {ASOF} SELECT event_id, account_no, feature_event_time IS NOT NULL AS found,
      coalesce(daily_amount, 0) AS daily_amount, coalesce(daily_count, 0) AS daily_count, coalesce(txn_count, 0) AS txn_count,
      coalesce(device_new, false) AS device_new, coalesce(known_device_count, 0) AS known_device_count,
      coalesce(unique_counterparty_count, 0) AS unique_counterparty_count,
      coalesce(epoch_us(feature_event_time), 0) AS feature_event_us FROM stored""",
)
def feat_point_in_time(spark, sf):
    counts = ["daily_amount", "daily_count", "txn_count", "known_device_count", "unique_counterparty_count"]
    return as_of(spark, sf).select(
        "event_id",
        "account_no",
        F.col("feature_event_time").isNotNull().alias("found"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("device_new", F.lit(False)).alias("device_new"),
        F.coalesce(F.unix_micros("feature_event_time"), F.lit(0)).alias("feature_event_us"),
    )


MODEL_FEATURES_SQL = """
modelf AS (
  SELECT event_id, source_id, txn_id, amount_minor / 100.0::DOUBLE AS amount, coalesce(daily_amount, 0) / 100.0::DOUBLE AS daily_amount,
    CAST(coalesce(daily_count, 0) AS DOUBLE) AS daily_count, CAST(hour(event_time) AS DOUBLE) AS hour,
    CASE WHEN counterparty IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cross_bank,
    CASE WHEN device_new THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS device_new
  FROM stored)"""


@query("model_features", f"WITH {TXN}, {FEAT}, {ASOF}, {MODEL_FEATURES_SQL} SELECT * FROM modelf")
def model_features(spark, sf):
    return features.model_features(as_of(spark, sf))


@query(
    "feature_parity",
    f"""WITH {TXN} SELECT count(*) AS events, CAST(0 AS BIGINT) AS one_sided, CAST(0 AS BIGINT) AS mismatch_daily_amount,
      CAST(0 AS BIGINT) AS mismatch_daily_count, CAST(0 AS BIGINT) AS mismatch_device_new FROM txn""",
)
def feature_parity(spark, sf):
    """The one-scan snapshot against the single-feature operators."""
    txn = tables.transactions(spark, sf)
    single = features.daily_running(txn).select("event_id", "daily_amount", "daily_count").join(
        features.device_new(txn).select("event_id", "device_new"), "event_id"
    )
    columns = ["event_id", "daily_amount", "daily_count", "device_new"]
    return features.parity_check(snapshot(spark, sf).select(*columns), single.select(*columns))
