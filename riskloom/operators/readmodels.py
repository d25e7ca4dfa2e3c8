"""Operational views over decisions, cases and dead events."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import Running, running, value_ranges
from ..session import materialize
from ..sources.schemas import DECISION_EVENT, RISK_LEVELS
from .common import latest_per


def _newest(df: DataFrame, tie: str) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), F.col(tie))


def search_decisions(
    decisions: DataFrame, level: str | None = None, txn_id: str | None = None, page: int = 0, size: int = 20
) -> DataFrame:
    """One page of decisions, newest first, with the total number of matches on every row."""
    page, size = max(page, 0), min(max(size, 1), 100)
    found = decisions
    if level is not None:
        found = found.filter(F.col("risk_level") == level)
    if txn_id is not None:
        found = found.filter(F.col("txn_id") == txn_id)
    total = found.agg(F.count(F.lit(1))).scalar()
    return _newest(found, "decision_id").offset(page * size).limit(size).withColumn("total", total)


def case_queue(cases: DataFrame, status: str | None = None, limit: int = 200) -> DataFrame:
    """The newest cases, of one status if given."""
    found = cases if status is None else cases.filter(F.col("status") == status)
    return _newest(found, "case_id").limit(limit)


def dead_events(outbox: DataFrame, dead_letters: DataFrame) -> DataFrame:
    """Undeliverable outbox messages and catalogued dead letters together."""
    columns = ["event_id", "event_kind", "topic", "attempts", "last_error", "created_at"]
    a = outbox.filter(F.col("status") == "DEAD").withColumn("event_kind", F.lit("OUTBOX"))
    b = (
        dead_letters.filter(F.col("status") == "DEAD")
        .withColumn("event_kind", F.lit("KAFKA_DLT"))
        .withColumn("topic", F.col("original_topic"))
    )
    return _newest(a.select(*columns).unionByName(b.select(*columns)), "event_id")


def outbox_backlog(outbox: DataFrame, now: Column) -> DataFrame:
    """Per topic: pending and due messages, dead ones, and the age of the oldest pending."""
    pending = F.col("status") == "PENDING"
    return outbox.groupBy("topic").agg(
        F.count(F.when(pending, 1)).alias("pending"),
        F.count(F.when(pending & (F.col("next_attempt_at") <= now), 1)).alias("due"),
        F.count(F.when(F.col("status") == "DEAD", 1)).alias("dead"),
        (F.unix_seconds(now) - F.unix_seconds(F.min(F.when(pending, F.col("created_at"))))).alias("oldest_seconds"),
    )


def status_counts(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "status", "n")


def overview(decisions: DataFrame, cases: DataFrame, dead: DataFrame, sample: int = 100) -> DataFrame:
    """The dashboard's head row: levels among the latest ``sample`` decisions, and all open cases."""
    latest = _newest(decisions, "decision_id").limit(sample)
    levels = [F.count(F.when(F.col("risk_level") == v, 1)).alias(v.lower()) for v in RISK_LEVELS]
    high = F.col("high") + F.col("reject")
    total = decisions.agg(F.count(F.lit(1))).scalar()
    open_cases = cases.filter(F.col("status") != "RESOLVED").agg(F.count(F.lit(1))).scalar()
    dead_total = dead.agg(F.count(F.lit(1))).scalar()
    return latest.agg(F.count(F.lit(1)).alias("shown"), *levels).select(
        "*",
        high.alias("high_risk"),
        F.round(high / F.greatest("shown", F.lit(1)) * 100).cast("bigint").alias("high_risk_percent"),
        open_cases.alias("open_cases"),
        total.alias("total"),
        dead_total.alias("dead_events"),
    )


def high_risk_decisions(decisions: DataFrame) -> DataFrame:
    """HIGH and rejected decisions, newest first; the event contract calls a reject CRITICAL."""
    return _newest(decisions.filter(F.col("risk_level").isin("HIGH", "REJECT", "CRITICAL")), "decision_id")


def percent_name(p: float, prefix: str = "p") -> str:
    """p50 for 0.5, p99 for 0.99, p999 for 0.999: the digits of the percentage without its point."""
    whole, _, rest = f"{Decimal(str(p)) * 100:f}".partition(".")
    return prefix + whole + rest.rstrip("0")


def latency_quantiles(decisions: DataFrame, window: str = "5 minutes", probabilities: Sequence[float] = (0.99, 0.999)) -> DataFrame:
    """Latency quantiles per window. Equal latencies are counted first, so a busy window stays small."""
    start = F.window("created_at", window)["start"].alias("window_start")
    counts = decisions.groupBy(start, "cost_ms").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("window_start").agg(
        F.sum("_n").alias("decisions"),
        *[F.percentile("cost_ms", p, F.col("_n")).alias(f"{percent_name(p)}_ms") for p in probabilities],
    )


def _growth(error: float) -> float:
    return (1 + error) / (1 - error)


def latency_sketch(decisions: DataFrame, window: str = "5 minutes", error: float = 0.01) -> DataFrame:
    """Mergeable quantile sketches of the latencies per window: decisions per bucket of values.

    Buckets grow by a fixed factor, so any value of a bucket is within the relative ``error`` of its middle; values
    below one count as zero, in bucket null. Sketches of parts, of shorter windows or of micro-batches add up
    (``rolled_up``). Works on tables and, with a watermark set, on streams.
    """
    bucket = F.when(F.col("cost_ms") >= 1, F.ceil(F.log("cost_ms") / math.log(_growth(error))).cast("int"))
    return (
        decisions.filter(F.col("cost_ms").isNotNull())
        .groupBy(F.window("created_at", window), bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("decisions"))
        .select(F.col("window.start").alias("window_start"), "bucket", "decisions")
    )


def rolled_up(sketch: DataFrame, window: str) -> DataFrame:
    """Sketches of windows put together into those of longer ones, or of repeated ones."""
    start = F.window("window_start", window)["start"].alias("window_start")
    return sketch.groupBy(start, "bucket").agg(F.sum("decisions").alias("decisions"))


def sketch_quantiles(sketch: DataFrame, probabilities: Sequence[float] = (0.99, 0.999), error: float = 0.01) -> DataFrame:
    """Lower quantiles per window, each within the relative ``error``: a window has few buckets, whatever it has counted."""
    growth, whole = _growth(error), Window.partitionBy("window_start")
    upto = whole.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.coalesce(2 * F.pow(F.lit(growth), F.col("bucket")) / (growth + 1), F.lit(0.0))
    counted = sketch.select("window_start", "decisions", middle.alias("_value"), F.sum("decisions").over(upto).alias("_upto"), F.sum("decisions").over(whole).alias("_all"))
    return counted.groupBy("window_start").agg(
        F.sum("decisions").alias("decisions"),
        *[F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * p), F.col("_value"))).alias(f"{percent_name(p)}_ms") for p in probabilities],
    )


def latency_alerts(latencies: DataFrame, window: timedelta = timedelta(minutes=5), held: timedelta = timedelta(minutes=10)) -> DataFrame:
    """Add ``p99_alert`` and ``p999_alert``: the quantile is over its limit in this window and in all that
    began in the ``held`` time before it. A window without decisions ends an alert."""
    limits = {"p99_ms": 50, "p999_ms": 100}  # fixed values of the alert rules, in milliseconds
    back = int(held.total_seconds() * 1_000_000)
    reach = Window.partitionBy(F.lit(0)).orderBy(F.unix_micros("window_start")).rangeBetween(-back, 0)  # one row per window
    needed = held // window + 1
    return latencies.withColumns(
        {name.replace("_ms", "_alert"): F.count_if(F.col(name) > limit).over(reach) >= needed for name, limit in limits.items()}
    )


def decision_rates(decisions: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Decisions per window, level, action and degradation."""
    degraded = F.exists("hit_rules", lambda c: c.startswith("DEGRADED_")).alias("degraded")
    start = F.window("created_at", window)["start"].alias("window_start")
    return decisions.groupBy(start, "risk_level", "action", degraded).agg(F.count(F.lit(1)).alias("decisions"))


def rule_hit_ratio(decisions: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Share of decisions with any hit per window."""
    start = F.window("created_at", window)["start"].alias("window_start")
    return decisions.groupBy(start).agg(
        F.count(F.lit(1)).alias("decisions"), F.avg((F.size("hit_rules") > 0).cast("int")).alias("hit_ratio")
    )


def quantiles(df: DataFrame, col: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact lower quantiles of a numeric column: the smallest value whose cumulative share reaches p."""
    counts = df.groupBy(F.col(col).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts, "value-counts")
    ranged = value_ranges(counts, "value", "_range")
    n = F.col("_n")
    cumulative = running(ranged, [], ["_range"], ["value"], [Running("_upto", n), Running("_total", n, how="total")])
    return cumulative.agg(
        *[F.min(F.when(F.col("_upto") >= F.col("_total") * p, F.col("value"))).alias(percent_name(p)) for p in probabilities]
    )


def approx_quantiles(df: DataFrame, col: str, probabilities: Sequence[float]) -> DataFrame:
    """Sketched quantiles in one pass."""
    return df.agg(*[F.percentile_approx(col, p).alias(percent_name(p)) for p in probabilities])


def replay(outbox: DataFrame, decision_ids: DataFrame, now: Column) -> DataFrame:
    """The newest decision message of each requested decision as a new message: new id and time, same content.

    ``decision_ids`` has one row per decision and its column is ``decision_id``.
    """
    wanted = outbox.filter(F.col("topic") == "decision.v1").join(
        decision_ids.select(F.col("decision_id").alias("aggregate_id")).distinct(), "aggregate_id", "left_semi"
    )
    newest = latest_per(wanted, ["aggregate_id"], ["created_at", "event_id"])
    new_id = F.sha2(F.concat_ws("|", "event_id", now.cast("string")), 256)
    iso = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    # only two fields of the metadata are new; all else, known to the event's schema or not, is kept as it is
    kind = "map<string,variant>"
    event = F.from_json("payload", kind)
    metadata = F.from_json(F.to_json(F.struct(event["metadata"].alias("m"))), f"m {kind}")["m"]

    def with_entries(held: Column, entries: dict[str, Column]) -> Column:
        fresh = F.create_map(*[x for name, value in entries.items() for x in (F.lit(name), F.parse_json(value))])
        return F.map_concat(F.map_filter(held, lambda k, _: ~k.isin(*entries)), fresh)

    def text(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))  # ids and times need no escapes

    renewed = with_entries(metadata, {"eventId": text(new_id), "occurredAt": text(iso)})
    fresh = F.to_json(with_entries(event, {"metadata": F.to_json(renewed)}))
    return newest.select(
        new_id.alias("event_id"), "aggregate_type", "aggregate_id", "topic", "message_key", fresh.alias("payload"), now.alias("created_at")
    )


def account_investigation(decisions: DataFrame, txn: DataFrame, edges: Sequence[int] = (100_000, 1_000_000, 5_000_000)) -> DataFrame:
    """Transactions, stops and amount ranges per account token."""
    amount = F.col("amount_minor")
    bounds = [None, *edges, None]
    ranges = []
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        inside = F.lit(True)
        inside = inside if low is None else inside & (amount >= low)
        inside = inside if high is None else inside & (amount < high)
        ranges.append(F.count(F.when(inside, 1)).alias(f"range_{i}"))
    keys = ["source_id", "txn_id"]
    return (
        decisions.select(*keys, "account_token", "action")
        .join(txn.select(*keys, "amount_minor"), keys)
        .groupBy("account_token")
        .agg(F.count(F.lit(1)).alias("txn_count"), F.sum(amount).alias("amount_minor"), F.count(F.when(F.col("action") == "REJECT", 1)).alias("rejected"), *ranges)
    )
