"""Customer tags. Cut-offs are parameters; their defaults are ours.

``df`` needs the key column, ``event_time`` and the columns a tag names. Amounts are minor units.
``cuts`` are time cuts as for the account features.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import Running, chunks, running, with_slot
from ..functions.text import non_blank
from .common import first_per

TS = "event_time"


def _last(days: int, as_of: Column) -> Column:
    return (F.col(TS) <= as_of) & (F.col(TS) > as_of - F.lit(timedelta(days=days)))


def _share(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def rfm(df: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Recency, frequency and money over 30 and 90 days, of customers active in the last 90."""
    recent = _last(30, as_of)
    amount = F.col("amount_minor")
    in30 = F.sum(F.when(recent, amount).otherwise(0))
    n30 = F.count(F.when(recent, 1))
    return (
        df.filter(_last(90, as_of))
        .groupBy(key)
        .agg(
            F.when(n30 > 0, in30 / n30).otherwise(0.0).alias("avg_amount_30d"),
            F.sum(amount).alias("total_amount_90d"),
            F.max(amount).alias("max_amount_90d"),
            n30.alias("frequency_30d"),
            in30.alias("monetary_30d"),
            F.datediff(as_of, F.max(TS)).alias("recency_days"),
        )
    )


def value_tier(rfm_tags: DataFrame, key: str, middle: int = 20_000_000, high: int = 50_000_000) -> DataFrame:
    total = F.col("total_amount_90d")
    return rfm_tags.select(key, F.when(total >= high, "HIGH").when(total >= middle, "MIDDLE").otherwise("LOW").alias("value_tier"))


def top_categories(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The most frequent value of each column per customer; ties go to the first in text order."""
    counts = df.unpivot([key], list(columns), "_dim", "_value").groupBy(key, "_dim", "_value").agg(F.count(F.lit(1)).alias("_n"))
    top = first_per(counts, [key, "_dim"], [F.col("_n").desc(), F.col("_value")])
    return top.groupBy(key).agg(*[F.max(F.when(F.col("_dim") == c, F.col("_value"))).alias(f"top_{c}") for c in columns])


def active_hour(df: DataFrame, key: str) -> DataFrame:
    """The part of the day with most events; ties go to the earlier part."""
    h = F.hour(TS)
    parts = {"NIGHT": h < 6, "MORNING": (h >= 6) & (h < 12), "AFTERNOON": (h >= 12) & (h < 18), "EVENING": h >= 18}
    counts = df.groupBy(key).agg(*[F.count(F.when(cond, 1)).alias(f"_{name}") for name, cond in parts.items()])
    ranked = F.array(*[F.struct(F.col(f"_{name}").alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("part")) for i, name in enumerate(parts)])
    return counts.select(key, F.array_max(ranked)["part"].alias("active_hour_pref"))


def night_ratio(df: DataFrame, key: str) -> DataFrame:
    """Share of events from midnight to six."""
    return df.groupBy(key).agg(_share(F.hour(TS) < 6).alias("night_txn_ratio"))


def segments(
    df: DataFrame, key: str, as_of: Column, active_days: int = 60, lost_days: int = 365, new_days: int = 180,
    growth_days: int = 720, frequent: int = 3, rich: int = 100_000_000,
) -> DataFrame:
    """RFM segment and lifecycle stage from the whole history up to ``as_of``."""
    year = _last(365, as_of)
    s = (
        df.filter(F.col(TS) <= as_of)
        .groupBy(key)
        .agg(
            F.datediff(as_of, F.max(TS)).alias("recency"),
            F.datediff(as_of, F.min(TS)).alias("age"),
            F.count(F.when(year, 1)).alias("frequency"),
            F.sum(F.when(year, F.col("amount_minor")).otherwise(0)).alias("money"),
        )
    )
    r, age = F.col("recency"), F.col("age")
    segment = (
        F.when(age <= new_days, "NEW")
        .when((r <= active_days) & (F.col("frequency") >= frequent) & (F.col("money") >= rich), "HIGH_VALUE_ACTIVE")
        .when(r <= active_days, "ACTIVE")
        .when(r <= lost_days, "DORMANT")
        .otherwise("CHURN_WARNING")
    )
    stage = (
        F.when(r > lost_days, "LOST")
        .when(r > active_days, "DECLINE")
        .when(age <= new_days, "NEW")
        .when(age <= growth_days, "GROWTH")
        .otherwise("MATURE")
    )
    return s.select(key, segment.alias("rfm_segment"), stage.alias("lifecycle_stage"))


def device_count(df: DataFrame, key: str, as_of: Column, days: int = 90) -> DataFrame:
    out = df.filter(_last(days, as_of)).groupBy(key)
    return out.agg(F.count_distinct(non_blank(F.col("device_id"))).alias("device_count_90d"))


def amount_volatility(df: DataFrame, key: str) -> DataFrame:
    """Coefficient of variation of the amounts."""
    amount = F.col("amount_minor").cast("double")
    return df.groupBy(key).agg(
        F.when(F.avg(amount) > 0, F.stddev_pop(amount) / F.avg(amount)).otherwise(0.0).alias("amount_volatility")
    )


def counterparty_concentration(df: DataFrame, key: str, top: int = 3) -> DataFrame:
    """Share of the money that goes to the customer's ``top`` counterparties."""
    sums = df.filter(F.col("counterparty").isNotNull()).groupBy(key, "counterparty").agg(F.sum("amount_minor").alias("_sum"))
    w = Window.partitionBy(key).orderBy(F.col("_sum").desc(), "counterparty")
    # the planner cuts to the top rows before the shuffle; the totals are a plain sum
    best = sums.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= top)
    share = best.groupBy(key).agg(F.sum("_sum").alias("_top"))
    total = sums.groupBy(key).agg(F.sum("_sum").alias("_total"))
    return total.join(share, key).select(key, (F.col("_top") / F.col("_total")).alias("counterparty_concentration"))


def ratios(df: DataFrame, key: str, round_unit: int = 10_000) -> DataFrame:
    """Shares of transfers to other parties and of round amounts."""
    return df.groupBy(key).agg(
        _share(F.col("counterparty").isNotNull()).alias("cross_bank_ratio"),
        _share(F.col("amount_minor") % round_unit == 0).alias("round_amount_ratio"),
    )


def net_flow(flows: DataFrame, key: str = "account") -> DataFrame:
    """Money in, out and net, of accounts that pay at all."""
    signed = F.col("signed_amount")
    s = flows.groupBy(key).agg(
        F.sum(F.when(signed > 0, signed).otherwise(0)).alias("inflow"),
        F.sum(F.when(signed < 0, -signed).otherwise(0)).alias("outflow"),
        F.count(F.when(signed < 0, 1)).alias("_payments"),
        F.sum(signed).alias("net_fund_flow"),
    )
    return s.filter(F.col("_payments") > 0).drop("_payments")


def fast_in_out(
    flows: DataFrame, key: str = "account", within: timedelta = timedelta(minutes=30), cuts: Sequence[float] | None = None
) -> DataFrame:
    """Share of the money paid out at most ``within`` after the latest receipt."""
    incoming = F.col("signed_amount") > 0
    moved = flows.filter(F.col("signed_amount") != 0).withColumn("_leg", F.when(incoming, 0).otherwise(1))
    rows = with_slot(moved, TS, "_slot", cuts)
    last_in = Running("_last_in", F.when(incoming, F.col(TS)), how="max")
    out = running(rows, [key], chunks(cuts, "_slot"), [TS, "_leg", "event_id"], [last_in]).filter(~incoming)
    fast = F.coalesce(F.col(TS) - F.col("_last_in") <= F.lit(within), F.lit(False))
    paid = -F.col("signed_amount")
    return out.groupBy(key).agg((F.sum(F.when(fast, paid).otherwise(0)) / F.sum(paid)).alias("fast_in_out_ratio"))


def network_change(df: DataFrame, key: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """Add ``geo_anomaly``: the network prefix differs from that of the previous event."""
    prefix = F.substring_index("ip", ".", 2)
    rows = with_slot(df.withColumn("_prefix", prefix), TS, "_slot", cuts)
    out = running(rows, [key], chunks(cuts, "_slot"), [TS, "event_id"], [Running("_before", F.col("_prefix"), how="last", prior=True)])
    return out.select(*df.columns, F.coalesce(F.col("_prefix") != F.col("_before"), F.lit(False)).alias("geo_anomaly"))


def trend(df: DataFrame, key: str, as_of: Column, period: int = 7, cuts: Sequence[float] | None = None) -> DataFrame:
    """Gaps between events, slope of the amount over days, and the last period against the one before."""
    rows = with_slot(df, TS, "_slot", cuts)
    spaced = running(rows, [key], chunks(cuts, "_slot"), [TS, "event_id"], [Running("_before", F.col(TS), how="last", prior=True)])
    gap = F.unix_seconds(TS) - F.unix_seconds("_before")
    day = F.datediff(F.to_date(TS), as_of).cast("double")
    yuan = F.col("amount_minor") / 100.0
    now = _last(period, as_of)
    earlier = _last(2 * period, as_of) & ~now
    current = F.sum(F.when(now, F.col("amount_minor")).otherwise(0))
    previous = F.sum(F.when(earlier, F.col("amount_minor")).otherwise(0))
    return spaced.groupBy(key).agg(
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("avg_gap_seconds"),
        F.coalesce(F.max(gap), F.lit(0)).alias("max_gap_seconds"),
        F.coalesce(F.regr_slope(yuan, day), F.lit(0.0)).alias("amount_slope"),
        current.alias("current_amount"),
        previous.alias("previous_amount"),
        F.when(previous > 0, (current - previous) / previous).otherwise(0.0).alias("growth"),
    )


def z_scores(df: DataFrame, key: str, col: str, clip: float = 3.0) -> DataFrame:
    """Fill a missing value by the mean, standardise it and clip outliers."""
    x = F.col(col).cast("double")
    stats = df.agg(F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))).scalar()
    scored = df.withColumn("_stats", stats)
    filled = F.coalesce(x, F.col("_stats.mean"))
    z = F.when(F.col("_stats.std") > 0, (filled - F.col("_stats.mean")) / F.col("_stats.std")).otherwise(0.0)
    return scored.select(key, filled.alias("filled"), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)).alias("z_score"))


def encoded(df: DataFrame, key: str, col: str, values: Sequence[str]) -> DataFrame:
    """Label index (-1 for other values) and one 0/1 column per allowed value."""
    index = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col)), F.lit(0)) - 1
    return df.select(key, index.alias(f"{col}_index"), *[(F.col(col) == v).cast("bigint").alias(f"is_{v.lower()}") for v in values])


def clusters(df: DataFrame, key: str, columns: Sequence[str], k: int = 4, seed: int = 42) -> DataFrame:
    """K-means groups over standardised columns."""
    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="cluster"),
    ]
    return Pipeline(stages=stages).fit(df).transform(df).select(key, "cluster")


def stale_tags(tags: DataFrame, key: str, computed_at: str, definitions: DataFrame, now: Column) -> DataFrame:
    """Tag values older than their definition's ``freshness_seconds``; definitions have one row per tag."""
    names = [c for c in tags.columns if c not in (key, computed_at)]
    long = tags.unpivot([key, computed_at], [F.col(c).cast("string").alias(c) for c in names], "tag_id", "value")
    age = F.unix_seconds(now) - F.unix_seconds(computed_at)
    joined = long.join(definitions, "tag_id").withColumn("age_seconds", age)
    return joined.filter(F.col("age_seconds") > F.col("freshness_seconds")).select(key, "tag_id", "age_seconds")
