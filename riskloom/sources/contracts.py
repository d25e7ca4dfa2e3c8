"""Reading and validating transaction messages."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank
from .schemas import BIZ_TYPES, CHANNELS, STATUSES, TRANSACTION_EVENT

_CORRUPT = "_corrupt"


def parse_transactions(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON messages to flat typed columns. Unknown fields are ignored; ``malformed`` marks text that
    is no JSON object. Works on batch and streaming input."""
    schema = T.StructType([*TRANSACTION_EVENT.fields, T.StructField(_CORRUPT, T.StringType())])
    event = F.from_json(payload, schema, {"columnNameOfCorruptRecord": _CORRUPT})
    e, m = "_event.", "_event.metadata."
    # as a generated row the message is parsed once, however many later filters read its fields
    return messages.select("*", F.explode(F.array(event)).alias("_event")).select(
        *messages.columns,
        (F.col("_event").isNull() | F.col(e + _CORRUPT).isNotNull()).alias("malformed"),
        F.col(m + "eventId").alias("event_id"),
        F.col(m + "correlationId").alias("correlation_id"),
        F.col(m + "sourceId").alias("source_id"),
        F.col(m + "txnId").alias("txn_id"),
        F.col(m + "occurredAt").try_cast("timestamp").alias("occurred_at"),
        F.col(m + "schemaVersion").alias("schema_version"),
        F.col(e + "channel").alias("channel"),
        F.col(e + "bizType").alias("biz_type"),
        F.col(e + "accountNo").alias("account_no"),
        F.col(e + "counterpartyAccount").alias("counterparty"),
        F.col(e + "amountMinor").alias("amount_minor"),
        F.col(e + "currency").alias("currency"),
        F.col(e + "deviceId").alias("device_id"),
        F.col(e + "ip").alias("ip"),
        F.col(e + "eventTime").try_cast("timestamp").alias("event_time"),
        F.col(e + "transactionStatus").alias("status"),
    )


def _reasons(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))


def contract_reasons(df: DataFrame) -> DataFrame:
    """Add ``violations``, the list of broken contract rules; a missing status becomes UNKNOWN."""
    required = ["event_id", "correlation_id", "source_id", "txn_id", "channel", "biz_type", "account_no", "currency"]
    checks = {f"{c} required": is_blank(F.col(c)) for c in required}
    checks["occurred_at required"] = F.col("occurred_at").isNull()
    checks["event_time required"] = F.col("event_time").isNull()
    checks["schema_version must be 1"] = ~F.col("schema_version").eqNullSafe(1)
    checks["amount_minor must be positive"] = ~F.coalesce(F.col("amount_minor") > 0, F.lit(False))
    checks["status unknown to the contract"] = F.col("status").isNotNull() & ~F.col("status").isin(STATUSES)
    if "malformed" in df.columns:
        rules = F.when(F.col("malformed"), F.array(F.lit("malformed"))).otherwise(_reasons(checks))
    else:
        rules = _reasons(checks)
    return df.withColumn("violations", rules).withColumn("status", F.coalesce("status", F.lit("UNKNOWN")))


def validate_contract(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (valid rows, rejected rows with their ``violations``)."""
    checked = contract_reasons(df)
    ok = F.size("violations") == 0
    return checked.filter(ok).drop("violations"), checked.filter(~ok)


def request_reasons(df: DataFrame) -> DataFrame:
    """Add ``violations`` of the request format: allowed values, currency code, lengths."""

    def too_long(c: str, cap: int) -> Column:
        return is_blank(F.col(c)) | (F.length(c) > cap)

    checks = {
        "source_id": too_long("source_id", 64),
        "txn_id": too_long("txn_id", 128),
        "account_no": too_long("account_no", 64),
        "channel": ~F.coalesce(F.col("channel").isin(CHANNELS), F.lit(False)),
        "biz_type": ~F.coalesce(F.col("biz_type").isin(BIZ_TYPES), F.lit(False)),
        "currency": ~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False)),
        "amount_minor": ~F.coalesce(F.col("amount_minor") > 0, F.lit(False)),
        "counterparty": F.length("counterparty") > 64,
        "device_id": F.length("device_id") > 128,
    }
    return df.withColumn("violations", _reasons(checks))


def event_time_reason(
    df: DataFrame, now: Column, max_age: timedelta = timedelta(days=90), skew: timedelta = timedelta(minutes=5)
) -> DataFrame:
    """Add ``time_violation``: TOO_OLD before now - max_age, IN_FUTURE after now + skew, else null."""
    t = F.col("event_time")
    return df.withColumn(
        "time_violation", F.when(t < now - F.lit(max_age), "TOO_OLD").when(t > now + F.lit(skew), "IN_FUTURE")
    )


def dead_letters(rejected: DataFrame, error: str = "rejected by the contract") -> DataFrame:
    """Catalogue rows of rejected messages, keyed by their position in the dead-letter topic."""
    dlt = F.concat("topic", F.lit(".DLT"))
    return rejected.select(
        F.concat_ws("-", F.lit("dlt"), dlt, F.col("partition").cast("string"), F.col("offset").cast("string")).alias("event_id"),
        dlt.alias("dlt_topic"),
        original_topic(dlt).alias("original_topic"),
        F.col("partition").cast("int").alias("partition_no"),
        F.col("offset").cast("bigint").alias("source_offset"),
        F.col("key").alias("message_key"),
        "payload",
        F.lit("DEAD").alias("status"),
        F.lit(0).cast("bigint").alias("attempts"),
        F.lit(error).alias("last_error"),
    )


def original_topic(dlt_topic: Column) -> Column:
    return F.regexp_replace(dlt_topic, "\\.DLT$", "")
