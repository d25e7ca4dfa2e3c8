from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("riskloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TXN = (
    "event_id string, account_no string, event_time timestamp, amount_minor bigint, device_id string, counterparty string, "
    "status string, source_id string, txn_id string, ip string"
)


def _txn(spark, rows):
    """Rows are (event_id, account, ISO time, amount[, device[, counterparty[, status]]])."""
    full = []
    for r in rows:
        r = [*r, *[None] * (7 - len(r))]
        full.append((r[0], r[1], r[2], r[3], r[4], r[5], r[6] or "UNKNOWN", "MOBILE_TRANSFER", "t" + r[0], "10.0.0.1"))
    schema = TXN.replace("event_time timestamp", "event_time string")
    return spark.createDataFrame(full, schema).withColumn("event_time", _ts("event_time"))


def _ts(c):
    from pyspark.sql import functions as F

    return F.col(c).cast("timestamp")


@pytest.fixture
def txn(spark):
    return lambda rows: _txn(spark, rows)
