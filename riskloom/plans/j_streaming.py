"""Streams over the given tables, each driven to the end of its input."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators.features import parity_check
from ..session import discard, release, shared_path
from ..sources import tables
from ..sources.contracts import parse_transactions
from ..sources.sinks import read_latest
from ..sources.versioned import fold
from ..streaming import features, patterns, runtime, sinks, windows
from .c_features import snapshot
from .d_patterns import FAILURES, LARGE, PROBE, PROBES, SIGNALS
from .e_decisions import records, reissued, stored
from .oracle import DECISIONS, FEAT, TXN
from .registry import query


def txn_stream(spark, sf):
    return tables.transactions_from_events(runtime.read_table_stream(runtime.prepare_streaming(spark), sf, "events"))


_COLUMNS = ["daily_amount", "daily_count", "txn_count", "device_new", "known_device_count", "unique_counterparty_count", "feature_event_us"]
_SQL_COLUMNS = ", ".join(_COLUMNS[:-1]) + ", epoch_us(feature_event_time) AS feature_event_us"


@query("stream_features", f"WITH {TXN}, {FEAT} SELECT account_no, event_id, {_SQL_COLUMNS} FROM feat")
def stream_features(spark, sf):
    out = features.stream_features(txn_stream(spark, sf), window=timedelta(hours=24), ttl_days=None)
    return runtime.run_fresh(out, "features").select("account_no", "event_id", *_COLUMNS)


_PARITY = ["daily_stat_date", *_COLUMNS]


@query(
    "feature_parity_stream",
    f"WITH {TXN} SELECT count(*) AS events, CAST(0 AS BIGINT) AS one_sided, {', '.join(f'CAST(0 AS BIGINT) AS mismatch_{c}' for c in _PARITY)} FROM txn",
)
def feature_parity_stream(spark, sf):
    """All eight features, batch against stream."""
    out = features.stream_features(txn_stream(spark, sf), window=timedelta(hours=24), ttl_days=None)
    streamed = runtime.run_fresh(out, "features").select("event_id", *_PARITY)
    batch = snapshot(spark, sf).withColumn("feature_event_us", F.unix_micros("feature_event_time")).select("event_id", *_PARITY)
    return parity_check(batch, streamed)


@query(
    "stream_feature_sink",
    f"""WITH {TXN}, {FEAT}, r AS (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY event_time DESC) AS rn FROM feat)
      SELECT account_no, event_id, {_SQL_COLUMNS} FROM r WHERE rn = 1""",
)
def stream_feature_sink(spark, sf):
    path, order = shared_path(spark, "feature-sink"), ["feature_event_us", "event_id"]
    out = features.stream_features(txn_stream(spark, sf), window=timedelta(hours=24), ttl_days=None)
    runtime.run_batches(out, sinks.keyed_sink(path, ["account_no"], order), shared_path(spark, "feature-sink-checkpoint"))
    return read_latest(spark, path).select("account_no", "event_id", *_COLUMNS)


@query("stream_dedup", f"WITH {TXN} SELECT event_id, account_no, amount_minor FROM txn")
def stream_dedup(spark, sf):
    """The events delivered twice."""
    twice = txn_stream(spark, sf).unionByName(txn_stream(spark, sf))
    out = windows.deduplicated(twice).select("event_id", "account_no", "amount_minor")
    return runtime.run_fresh(out, "dedup")


@query(
    "stream_patterns",
    f"""WITH {TXN}, {PROBES}, {FAILURES}, wm AS (SELECT max(event_time) - INTERVAL 2 MINUTES AS t FROM txn)
      SELECT 'PROBE_THEN_LARGE' AS signal_type, account_no, probe_event_id AS first_event_id, large_event_id AS last_event_id,
        probe_amount AS first_value, large_amount AS last_value FROM probe WHERE large_time <= (SELECT t FROM wm)
      UNION ALL SELECT 'FAILED_THEN_SUCCESS', account_no, first_event_id, success_event_id, failure_count, match_count
      FROM failures WHERE success_time <= (SELECT t FROM wm)""",
)
def stream_patterns(spark, sf):
    out = patterns.stream_patterns(txn_stream(spark, sf), PROBE, LARGE, timedelta(hours=24), 3, timedelta(hours=72))
    found = runtime.run_fresh(out, "patterns")
    return found.select("signal_type", "account_no", "first_event_id", "last_event_id", "first_value", "last_value")


@query(
    "stream_signals",
    f"""WITH {TXN}, {PROBES}, {FAILURES}, {SIGNALS}, wm AS (SELECT max(event_time) - INTERVAL 2 MINUTES AS t FROM txn)
      SELECT sha256(signal_type || '|' || account_no || '|' || related) AS signal_id, 'HIGH' AS severity, signal_type, account_no, related, attributes
      FROM signal WHERE detected_at <= (SELECT t FROM wm)""",
)
def stream_signals(spark, sf):
    """Signals filed by id, so a batch that is delivered again changes nothing."""
    path = shared_path(spark, "signals")
    found = patterns.stream_patterns(txn_stream(spark, sf), PROBE, LARGE, timedelta(hours=24), 3, timedelta(hours=72))
    runtime.run_batches(patterns.stream_signals(found), sinks.keyed_sink(path, ["signal_id"], ["detected_at"]), shared_path(spark, "signals-checkpoint"))
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return read_latest(spark, path).select(
        "signal_id", "severity", "signal_type", "account_no",
        F.concat_ws("|", "related_event_ids").alias("related"), F.concat_ws(",", pairs).alias("attributes"),
    )


@query(
    "stream_decision_metrics",
    f"""WITH {DECISIONS}, w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, created_at) - INTERVAL 4 MINUTES,
        time_bucket(INTERVAL 1 MINUTE, created_at), INTERVAL 1 MINUTE)) AS s, * FROM decision)
      SELECT epoch_us(s) AS window_start_us, risk_level, action, count(*) AS decisions, CAST(sum(cost_ms) AS BIGINT) AS cost_ms,
        count(*) FILTER (WHERE hit_rules <> '') AS with_hits
      FROM w WHERE s + INTERVAL 5 MINUTES <= (SELECT max(created_at) - INTERVAL 2 MINUTES FROM decision) GROUP BY 1, 2, 3""",
)
def stream_decision_metrics(spark, sf):
    """Decisions are published to a table first, as the decision topic is, and streamed from there."""
    runtime.prepare_streaming(spark)
    topic = shared_path(spark, "decisions")
    records(spark, sf).select("created_at", "risk_level", "action", "cost_ms", "hit_rules").write.parquet(topic)
    stream = spark.readStream.schema(spark.read.parquet(topic).schema).parquet(topic)
    found = runtime.run_fresh(windows.decision_metrics(stream), "decision-metrics")
    return found.select(F.unix_micros("window_start").alias("window_start_us"), "risk_level", "action", "decisions", "cost_ms", "with_hits")


@query("stream_search_projection", f"WITH {DECISIONS} SELECT decision_id, txn_id, account_token, risk_level, action, cost_ms * 2 AS cost_ms FROM decision")
def stream_search_projection(spark, sf):
    """Decision events, each delivered twice, projected for search: one row per decision, the later delivery wins."""
    runtime.prepare_streaming(spark)
    topic, path = shared_path(spark, "decisions"), shared_path(spark, "search")
    first = stored(spark, sf, "decision_id", "txn_id", "account_token", "risk_level", "action", "cost_ms", "created_at")
    reissued(first).write.option("compression", "zstd").parquet(topic)
    discard(first)
    release(spark)
    stream = spark.readStream.schema(spark.read.parquet(topic).schema).option("maxFilesPerTrigger", 8).parquet(topic)
    runtime.run_batches(stream, sinks.keyed_sink(path, ["decision_id"], ["created_at", "cost_ms"]), shared_path(spark, "search-checkpoint"))
    fold(spark, path)
    return read_latest(spark, path).drop("created_at")


@query(
    "stream_tumbling_totals",
    f"""WITH {TXN} SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, event_time)) AS window_start_us, account_no,
        CAST(sum(amount_minor) AS BIGINT) AS amount_minor, count(*) AS txn_count
      FROM txn WHERE time_bucket(INTERVAL 1 HOUR, event_time) + INTERVAL 1 HOUR <= (SELECT max(event_time) - INTERVAL 2 MINUTES FROM txn) GROUP BY 1, 2""",
)
def stream_tumbling_totals(spark, sf):
    found = runtime.run_fresh(windows.tumbling_totals(txn_stream(spark, sf)), "totals")
    return found.select(F.unix_micros("window_start").alias("window_start_us"), "account_no", "amount_minor", "txn_count")


@query(
    "stream_session_totals",
    f"""WITH {TXN}, g AS (SELECT *, coalesce(event_time - lag(event_time) OVER w > INTERVAL 6 HOURS, true) AS opens FROM txn WINDOW w AS (PARTITION BY account_no ORDER BY event_time)),
      s AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY account_no ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS session FROM g)
      SELECT epoch_us(min(event_time)) AS session_start_us, epoch_us(max(event_time) + INTERVAL 6 HOURS) AS session_end_us, account_no,
        CAST(sum(amount_minor) AS BIGINT) AS amount_minor, count(*) AS txn_count FROM s GROUP BY account_no, session
      HAVING max(event_time) + INTERVAL 6 HOURS <= (SELECT max(event_time) - INTERVAL 2 MINUTES FROM txn)""",
)
def stream_session_totals(spark, sf):
    found = runtime.run_fresh(windows.session_totals(txn_stream(spark, sf), "6 hours"), "sessions")
    return found.select(
        F.unix_micros("session_start").alias("session_start_us"), F.unix_micros("session_end").alias("session_end_us"), "account_no", "amount_minor", "txn_count"
    )


@query(
    "stream_dead_letters",
    f"""WITH {TXN} SELECT 'dlt-transaction.v1.DLT-' || (n % 4) || '-' || (n // 4) AS event_id, account_no AS message_key, 'DEAD' AS status
      FROM txn WHERE n % 97 = 0 OR amount_minor <= 0""",
)
def stream_dead_letters(spark, sf):
    valid, dead = shared_path(spark, "valid"), shared_path(spark, "dead")
    parsed = parse_transactions(tables.envelopes(txn_stream(spark, sf)))
    runtime.run_batches(parsed, sinks.dead_letter_split(valid, dead), shared_path(spark, "dead-checkpoint"))
    return read_latest(spark, dead).select("event_id", "message_key", "status")
