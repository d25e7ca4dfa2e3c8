"""90-day customer profiles, kept up to date for the customers an increment affects."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import salted_join
from ..functions.text import non_blank
from ..session import discard, materialize
from ..sources.versioned import PART, part_name, parts_of, read_version, replace_parts, upsert, version
from .facts import KEYS

WINDOW = timedelta(days=90)


def _seconds(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def affected_customers(facts: DataFrame, labels: DataFrame, watermark: Column, as_of: Column) -> DataFrame:
    """Customers with a new fact, a fact that left the window since, or a new label.

    All bounds are compared with the bare column, so the source can skip row groups.
    """
    t = F.col("event_time")
    mark, start = _seconds(watermark), _seconds(as_of) - F.lit(WINDOW)
    by_fact = facts.filter((t >= mark) | ((t < start) & (t >= mark - F.lit(WINDOW)))).select("customer_id")
    fresh = labels.filter(F.col("created_at") >= watermark).select(*KEYS)
    by_label = facts.select("customer_id", *KEYS).join(fresh, KEYS).select("customer_id")
    return by_fact.union(by_label).distinct()


def window_facts(facts: DataFrame, as_of: Column) -> DataFrame:
    """Facts of the 90 days up to ``as_of``, both ends included at second precision."""
    end = _seconds(as_of)
    t = F.col("event_time")
    return facts.filter((t >= end - F.lit(WINDOW)) & (t < end + F.expr("INTERVAL 1 SECOND")))


def night(ts: Column, zone: str) -> Column:
    h = F.hour(F.from_utc_timestamp(ts, zone))
    return (h < 6) | (h >= 23)


def _fraud_counts(recent: DataFrame, labels: DataFrame) -> DataFrame:
    """Confirmed frauds per customer. Only FRAUD labels are joined: the planner can filter the facts
    by them before anything is shuffled."""
    fraud = labels.filter(F.col("label") == "FRAUD").select(*KEYS)
    return (
        recent.select("customer_id", *KEYS).join(fraud, KEYS).groupBy("customer_id").agg(F.count(F.lit(1)).alias("fraud_count_90d"))
    )


def _aggregate(recent: DataFrame, as_of: Column, zone: str, distinct: Column, recency: Column) -> DataFrame:
    return recent.groupBy("customer_id").agg(
        F.sum("amount_minor").alias("amount_90d"),
        F.count(F.lit(1)).alias("txn_cnt_90d"),
        distinct.alias("unique_counterparty_90d"),
        recency.alias("recency_days"),
        F.avg(night(F.col("event_time"), zone).cast("int")).alias("night_ratio"),
        F.max("event_time").alias("profile_as_of"),
    )


def _completed(customers: DataFrame, stats: DataFrame, frauds: DataFrame, as_of: Column) -> DataFrame:
    """One row per customer; those without facts in the window get zeros and a recency of 91 days."""
    defaults = {
        "amount_90d": F.lit(0).cast("bigint"),
        "txn_cnt_90d": F.lit(0).cast("bigint"),
        "unique_counterparty_90d": F.lit(0).cast("bigint"),
        "recency_days": F.lit(91),
        "night_ratio": F.lit(0.0),
        "fraud_count_90d": F.lit(0).cast("bigint"),
        "profile_as_of": as_of,
    }
    joined = customers.join(stats, "customer_id", "left").join(frauds, "customer_id", "left")
    return joined.select("customer_id", *[F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()])


def profile_90d(
    facts: DataFrame, labels: DataFrame, watermark: Column, as_of: Column, zone: str = "UTC", exact: bool = False
) -> DataFrame:
    """Profiles of the affected customers. Only their facts are aggregated, and these as partial rows before they are
    shuffled, so a busy customer costs no more than any other."""
    customers = affected_customers(facts, labels, watermark, as_of)
    recent = salted_join(window_facts(facts, as_of), customers, ["customer_id"], KEYS, "left_semi")
    distinct = F.count_distinct(F.col("counterparty_id")) if exact else F.approx_count_distinct("counterparty_id")
    recency = F.datediff(as_of, F.max(F.to_date("event_time")))
    stats = _aggregate(recent, as_of, zone, distinct, recency)
    return _completed(customers, stats, _fraud_counts(recent, labels), as_of)


#: What a partial holds beside customer, day and counterparty; all of it adds up or is a maximum.
PARTIAL = ["amount", "txns", "nights", "latest"]


def daily_partials(facts: DataFrame, zone: str = "UTC") -> DataFrame:
    """Facts summed by customer, UTC day and counterparty: rows that can be merged into profiles of any run of days."""
    return facts.groupBy("customer_id", F.to_date("event_time").alias("day"), "counterparty_id").agg(
        F.sum("amount_minor").alias("amount"),
        F.count(F.lit(1)).alias("txns"),
        F.count_if(night(F.col("event_time"), zone)).alias("nights"),
        F.max("event_time").alias("latest"),
    )


def span_name(day: Column, unit: str) -> Column:
    """The part that a day lies in: its own, or that of its month or other ``unit`` where days are too small for a part each."""
    return part_name(F.date_trunc(unit, day).cast("date"))


def write_partials(spark: SparkSession, path: str, facts: DataFrame, zone: str = "UTC", unit: str = "day") -> None:
    """Put the partials of some days (or other units) into a versioned table with a part for each.

    ``facts`` are all facts of these; those that are stored already are replaced, others are left as they are.
    """
    rows = daily_partials(facts, zone).withColumn(PART, span_name(F.col("day"), unit))
    rows = materialize(rows, "profile-partials")
    replace_parts(rows, path, version(spark, path), parts_of(rows))
    discard(rows)


def profile_90d_partials(
    spark: SparkSession,
    path: str,
    facts: DataFrame,
    labels: DataFrame,
    watermark: Column,
    as_of: Column,
    zone: str = "UTC",
    unit: str = "day",
) -> DataFrame:
    """``profile_90d`` with exact distinct counts, from stored partials.

    Whole days of the window are read from their parts, of affected customers only; the facts themselves are
    read for the days that the window's ends cut. From one day to the next a window thus adds the parts of
    one day and drops those of another.
    """
    end = spark.range(1).select(_seconds(as_of)).first()[0]
    start = end - WINDOW
    midnight = datetime(start.year, start.month, start.day)
    first = midnight if start == midnight else midnight + timedelta(days=1)
    whole = [first.date() + timedelta(days=i) for i in range((end.date() - first.date()).days)]
    days = spark.createDataFrame([(d,) for d in whole], "d date").select(span_name(F.col("d"), unit)).distinct()
    stored = read_version(spark, path, parts=[r[0] for r in days.collect()])
    t = F.col("event_time")
    cut = (t < F.lit(first)) | (t >= F.lit(datetime(end.year, end.month, end.day)))
    rest = daily_partials(window_facts(facts, as_of).filter(cut), zone)
    customers = materialize(affected_customers(facts, labels, watermark, as_of), "affected")
    if stored is None:
        rows = rest
    else:
        inside = F.col("day").between(F.lit(whole[0]), F.lit(whole[-1]))
        rows = stored.filter(inside).select(*rest.columns).unionByName(rest)
    own = salted_join(rows, customers, ["customer_id"], ["day", "counterparty_id"], "left_semi")
    by_party = own.groupBy("customer_id", "counterparty_id").agg(
        *[F.sum(c).alias(c) for c in PARTIAL[:3]], F.max("latest").alias("latest")
    )
    stats = by_party.groupBy("customer_id").agg(
        F.sum("amount").alias("amount_90d"),
        F.sum("txns").alias("txn_cnt_90d"),
        F.count("counterparty_id").alias("unique_counterparty_90d"),
        F.datediff(as_of, F.to_date(F.max("latest"))).alias("recency_days"),
        (F.sum("nights") / F.sum("txns")).alias("night_ratio"),
        F.max("latest").alias("profile_as_of"),
    )
    recent = salted_join(window_facts(facts, as_of), customers, ["customer_id"], KEYS, "left_semi")
    return _completed(customers, stats, _fraud_counts(recent, labels), as_of)


def profile_90d_exact(facts: DataFrame, labels: DataFrame, as_of: Column, zone: str = "UTC") -> DataFrame:
    """Profiles of all customers in the window, with exact distinct non-blank counterparties and recency
    in whole elapsed days."""
    recent = window_facts(facts, as_of)
    elapsed = (F.unix_micros(as_of) - F.unix_micros(F.max("event_time"))) / F.lit(86_400_000_000)
    stats = _aggregate(
        recent, as_of, zone, F.count_distinct(non_blank(F.col("counterparty_id"))), F.floor(elapsed).cast("int")
    )
    return _completed(recent.select("customer_id").distinct(), stats, _fraud_counts(recent, labels), as_of)


def merge_profiles(target: DataFrame, updates: DataFrame, affected: DataFrame) -> DataFrame:
    """Replace all affected customers and keep the rest."""
    kept = target.join(affected.select("customer_id").distinct(), "customer_id", "left_anti")
    return kept.unionByName(updates)


def write_profiles(spark: SparkSession, path: str, updates: DataFrame, affected: DataFrame | None = None) -> None:
    """Merge profiles into a keyed table: affected customers are replaced, or go where they have no profile any more.

    Only the buckets of these customers are rewritten, in one step. The later profile of a customer stays.
    """
    upsert(spark, path, updates, ["customer_id"], ["profile_as_of"], removed=affected)


def incremental_parity(
    facts: DataFrame, labels: DataFrame, before: Column, as_of: Column, zone: str = "UTC"
) -> DataFrame:
    """How many profiles an incremental update has that a full recomputation lacks, and the reverse.

    The base is the state at ``before`` of everything known then; the increment covers the time
    from there to ``as_of``. Recency is measured at different times in both, so it is left out.
    """
    start = F.lit("1970-01-01").cast("timestamp")
    known_facts, known_labels = facts.filter(F.col("event_time") < before), labels.filter(F.col("created_at") < before)
    columns = ["customer_id", "amount_90d", "txn_cnt_90d", "unique_counterparty_90d", "night_ratio", "fraud_count_90d"]
    base = profile_90d(known_facts, known_labels, start, before, zone, exact=True)
    updates = profile_90d(facts, labels, before, as_of, zone, exact=True)
    merged = merge_profiles(base, updates, updates).select(*columns, F.lit(1).alias("_side"))
    full = profile_90d(facts, labels, start, as_of, zone, exact=True).select(*columns, F.lit(-1).alias("_side"))
    balance = merged.union(full).groupBy(*columns).agg(F.sum("_side").alias("_balance"))
    return balance.agg(
        F.count_distinct("customer_id").alias("customers"),
        F.sum(F.greatest("_balance", F.lit(0))).alias("only_incremental"),
        F.sum(F.greatest(-F.col("_balance"), F.lit(0))).alias("only_full"),
    )
