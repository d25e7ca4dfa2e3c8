"""The transaction views read from the event and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def transactions_from_events(events: DataFrame) -> DataFrame:
    """One payment event per row of ``events``, with the flags the rules read."""
    # json_tuple generates a row, so filters on what is derived from it do not parse the text again
    parsed = events.selectExpr(
        "event_id AS n",
        "user_id",
        "event_type",
        "value",
        "CAST(ts AS TIMESTAMP) AS event_time",
        "json_tuple(props, 'k') AS k",
    )
    return parsed.selectExpr(
        "n",
        "concat('e-', n) AS event_id",
        "concat('t-', n) AS txn_id",
        "element_at(array('MOBILE_TRANSFER', 'WEB_BANK', 'ATM_NET', 'API_PARTNER'), CAST(n % 4 + 1 AS INT)) AS source_id",
        "element_at(array('MOBILE', 'WEB', 'ATM', 'API', 'BRANCH'), CAST(n % 5 + 1 AS INT)) AS channel",
        "element_at(array('TRANSFER', 'REMITTANCE', 'PAYMENT', 'WITHDRAWAL'), CAST((n DIV 4) % 4 + 1 AS INT)) AS biz_type",
        "concat('6225', lpad(user_id, 12, '0')) AS account_no",
        "CASE WHEN CAST(k AS INT) % 10 <> 0 AND CAST(k AS INT) <> user_id THEN concat('6225', lpad(k, 12, '0')) END AS counterparty",
        "CAST(round(value * 100) AS BIGINT) * 400 AS amount_minor",
        "concat('d-', user_id DIV 3, '-', CAST(k AS INT) % 2) AS device_id",
        "concat('10.', n % 3, '.', user_id % 256, '.1') AS ip",
        "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCESS' ELSE 'UNKNOWN' END AS status",
        "event_time",
        "'CNY' AS currency",
        "user_id % 50 = 7 AS blacklist",
        "n % 101 <> 0 AS features_available",
        "user_id DIV 3 = 3 AND CAST(k AS INT) % 2 = 1 AS device_blacklist",
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(table(spark, sf_dir, "events"))


def flows(txn: DataFrame) -> DataFrame:
    """Two legs per transfer: out of the account, and into the counterparty where there is one."""
    out = txn.select(
        F.col("account_no").alias("account"), "event_time", "event_id", (-F.col("amount_minor")).alias("signed_amount")
    )
    into = txn.filter(F.col("counterparty").isNotNull()).select(
        F.col("counterparty").alias("account"), "event_time", "event_id", F.col("amount_minor").alias("signed_amount")
    )
    return out.unionByName(into)


def _order_time() -> Column:
    """Order dates are midnights; the order number spreads them over the day."""
    return F.timestamp_micros(
        F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * F.lit(3_600_000_000)
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pseudonymous transaction fact per order."""
    orders = table(spark, sf_dir, "orders")
    supplier = (
        table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("supp"))
    )
    return orders.join(supplier, "o_orderkey", "left").select(
        F.lit("ORD").alias("source_id"),
        F.col("o_orderkey").cast("string").alias("txn_id"),
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("s-"), F.col("supp").cast("string")).alias("counterparty_id"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount_minor"),
        _order_time().alias("event_time"),
    )


def _label() -> Column:
    return F.when(F.col("toxic") == 1, "FRAUD").otherwise("NORMAL").alias("label")


def case_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst labels keyed like the transactions."""
    txn = transactions(spark, sf_dir).select("n", "source_id", "txn_id", "event_time")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "n")
    return labels.join(txn, "n").select(
        "source_id", "txn_id", _label(), (F.col("event_time") + F.expr("INTERVAL 1 HOUR")).alias("created_at")
    )


def fact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst labels keyed like the order facts."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), _order_time().alias("event_time")
    )
    return (
        table(spark, sf_dir, "labels")
        .join(orders, "doc_id")
        .select(
            F.lit("ORD").alias("source_id"),
            F.col("doc_id").cast("string").alias("txn_id"),
            _label(),
            (F.col("event_time") + F.expr("INTERVAL 1 HOUR")).alias("created_at"),
        )
    )


def envelope_struct() -> Column:
    """The nested event of one transaction row."""
    iso = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.struct(
        F.struct(
            F.col("event_id").alias("eventId"),
            F.concat(F.lit("c-"), F.col("txn_id")).alias("correlationId"),
            F.col("source_id").alias("sourceId"),
            F.col("txn_id").alias("txnId"),
            iso.alias("occurredAt"),
            F.lit(1).alias("schemaVersion"),
        ).alias("metadata"),
        F.col("channel"),
        F.col("biz_type").alias("bizType"),
        F.col("account_no").alias("accountNo"),
        F.col("counterparty").alias("counterpartyAccount"),
        F.col("amount_minor").alias("amountMinor"),
        F.col("currency"),
        F.col("device_id").alias("deviceId"),
        F.col("ip"),
        iso.alias("eventTime"),
        F.col("status").alias("transactionStatus"),
    )


def envelopes(txn: DataFrame) -> DataFrame:
    """Transactions as JSON messages on a topic; every 97th message is cut short."""
    body = F.to_json(envelope_struct())
    return txn.select(
        F.lit("transaction.v1").alias("topic"),
        (F.col("n") % 4).cast("int").alias("partition"),
        F.floor(F.col("n") / 4).cast("bigint").alias("offset"),
        F.col("account_no").alias("key"),
        F.when(F.col("n") % 97 == 0, F.substring(body, 1, 40)).otherwise(body).alias("payload"),
    )


def fixture_score(df: DataFrame) -> DataFrame:
    """A stand-in for a trained model: ``fraud_score`` of a logistic formula, rounded to six digits."""
    # fixed values: the weights by which the test labels are usually drawn
    daily_amount = F.coalesce("daily_amount", F.lit(0)) / 100.0
    z = (
        F.lit(-3.0)
        + F.col("amount_minor") / 100.0 * 0.00002
        + daily_amount * 0.000015
        + F.when(F.col("device_new"), 1.2).otherwise(0.0)
        + F.when(F.col("counterparty").isNotNull(), 0.6).otherwise(0.0)
        + F.when(F.hour("event_time") < 6, 1.0).otherwise(0.0)
        + F.coalesce("daily_count", F.lit(0)) * 0.05
    )
    return df.withColumn("fraud_score", F.round(1.0 / (1.0 + F.exp(-z)), 6))


def requests(as_of: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Transactions as they reach the decision, with a correlation id, and the clock and cost of each evaluation."""
    asked = as_of.withColumn("correlation_id", F.concat(F.lit("c-"), F.col("txn_id")))
    return asked, {"created_at": F.col("event_time"), "cost_ms": F.col("n") % 120}
