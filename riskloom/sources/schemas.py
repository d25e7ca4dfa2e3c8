"""Explicit schemas of events and tables."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA = T.StructType(
    [
        T.StructField("eventId", T.StringType()),
        T.StructField("correlationId", T.StringType()),
        T.StructField("sourceId", T.StringType()),
        T.StructField("txnId", T.StringType()),
        T.StructField("occurredAt", T.StringType()),
        T.StructField("schemaVersion", T.IntegerType()),
    ]
)

TRANSACTION_EVENT = T.StructType(
    [
        T.StructField("metadata", METADATA),
        T.StructField("channel", T.StringType()),
        T.StructField("bizType", T.StringType()),
        T.StructField("accountNo", T.StringType()),
        T.StructField("counterpartyAccount", T.StringType()),
        T.StructField("amountMinor", T.LongType()),
        T.StructField("currency", T.StringType()),
        T.StructField("deviceId", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("eventTime", T.StringType()),
        T.StructField("transactionStatus", T.StringType()),
    ]
)

_HIT = T.StructType(
    [
        T.StructField("ruleCode", T.StringType()),
        T.StructField("ruleName", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("reason", T.StringType()),
    ]
)
DECISION_EVENT = T.StructType(
    [
        T.StructField("metadata", METADATA),
        T.StructField("decisionId", T.StringType()),
        T.StructField("riskLevel", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("fraudScore", T.DoubleType()),
        T.StructField("hitRules", T.ArrayType(_HIT)),
        T.StructField("featureSnapshot", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ruleVersion", T.StringType()),
        T.StructField("modelVersion", T.StringType()),
        T.StructField("costMs", T.LongType()),
    ]
)

# Fixed values of the event contract.
CHANNELS = ["MOBILE", "WEB", "ATM", "API", "BRANCH"]
BIZ_TYPES = ["TRANSFER", "REMITTANCE", "PAYMENT", "WITHDRAWAL"]
STATUSES = ["SUCCESS", "FAILED", "UNKNOWN"]
MODEL_FEATURES = ["amount", "daily_amount", "daily_count", "hour", "cross_bank", "device_new"]
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH", "REJECT"]
