"""Rules, bindings and decision records on golden cases."""

from __future__ import annotations

import hashlib
import hmac
import json
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from riskloom.functions.text import is_blank, hmac_sha256, key_bucket, mask_middle, mask_tail, text_to_bool, text_to_long
from riskloom.operators import decisions as dec
from riskloom.operators import rules
from riskloom.sources import contracts

BASE = dict(
    source_id="MOBILE_TRANSFER", txn_id="t-1", event_id="e-1", account_no="6225000000000001", counterparty=None, channel="ATM",
    biz_type="TRANSFER", amount_minor=10_000, currency="CNY", device_id="d", ip="10.0.0.1", status="SUCCESS", blacklist=False,
    device_blacklist=False, features_available=True, daily_amount=None, daily_count=None, txn_count=None, device_new=None,
    known_device_count=None, unique_counterparty_count=None, daily_stat_date=None, feature_event_time=None, correlation_id="corr-1",
)
SCHEMA = """source_id string, txn_id string, event_id string, account_no string, counterparty string, channel string, biz_type string,
  amount_minor bigint, currency string, device_id string, ip string, status string, blacklist boolean, device_blacklist boolean,
  features_available boolean, daily_amount bigint, daily_count bigint, txn_count bigint, device_new boolean, known_device_count bigint,
  unique_counterparty_count bigint, daily_stat_date date, feature_event_time timestamp, correlation_id string"""


def decide(spark, score=0.0, **changes):
    row = tuple({**BASE, **changes}.values())
    df = spark.createDataFrame([row], SCHEMA).withColumn("event_time", F.lit("2026-07-22 10:00:00").cast("timestamp"))
    return dec.decide(df, "k", scorer=lambda d: d.withColumn("fraud_score", F.lit(score)))


@pytest.mark.parametrize(
    "changes,level,action,hits",
    [
        ({}, "LOW", "ALLOW", []),
        ({"amount_minor": 6_000_000}, "HIGH", "REVIEW", ["LARGE_TRANSFER"]),
        ({"blacklist": True}, "REJECT", "REJECT", ["BLACKLIST_ACCOUNT"]),
        ({"daily_amount": 20_000_000}, "HIGH", "REVIEW", ["DAILY_AMOUNT_EXCEEDED"]),
        ({"amount_minor": 8_000_000, "channel": "MOBILE"}, "HIGH", "REVIEW", ["DT_MOBILE_LARGE", "LARGE_TRANSFER"]),
        ({"txn_count": 6}, "HIGH", "REVIEW", ["HIGH_VELOCITY"]),
        ({"amount_minor": 6_000_000, "blacklist": True}, "REJECT", "REJECT", ["BLACKLIST_ACCOUNT", "LARGE_TRANSFER"]),
        ({"amount_minor": 2_000_000, "device_new": True}, "MEDIUM", "CHALLENGE", ["NEW_DEVICE_MID_AMOUNT"]),
        ({"score": 0.9}, "HIGH", "REVIEW", ["MODEL_MID_RISK"]),
        ({"score": 0.91}, "REJECT", "REJECT", ["MODEL_HIGH_RISK"]),
        ({"features_available": False, "blacklist": True}, "MEDIUM", "CHALLENGE", ["DEGRADED_FEATURE_UNAVAILABLE"]),
        ({"source_id": "API_PARTNER", "features_available": False}, "HIGH", "REVIEW", ["DEGRADED_ENGINE_UNAVAILABLE"]),
    ],
)
def test_golden_decisions(spark, changes, level, action, hits):
    row = decide(spark, **changes).first()
    assert (row.risk_level, row.action, row.hit_rules) == (level, action, hits)


def test_degraded_versions(spark):
    blind = decide(spark, features_available=False, score=0.99).first()
    assert (blind.model_version, blind.rule_version, blind.fraud_score, blind.feature_snapshot) == ("not-evaluated", "baseline-1", 0.0, {})
    unbound = decide(spark, source_id="API_PARTNER").first()
    assert (unbound.model_version, unbound.rule_version) == ("unavailable", "unavailable")


def test_outbox_has_two_messages_and_critical_level(spark):
    rows = {r.topic: r for r in dec.outbox(decide(spark, blacklist=True)).collect()}
    assert set(rows) == {"transaction.v1", "decision.v1"} and {r.message_key for r in rows.values()} == {BASE["account_no"]}
    event = json.loads(rows["decision.v1"].payload)
    assert event["riskLevel"] == "CRITICAL"
    assert event["hitRules"] == [{"ruleCode": "BLACKLIST_ACCOUNT", "ruleName": "BLACKLIST_ACCOUNT", "score": 0, "reason": "BLACKLIST_ACCOUNT"}]


def test_correlation_clock_cost_and_snapshot(spark):
    row = decide(spark, daily_amount=7, daily_count=1, txn_count=2, device_new=True, known_device_count=1, unique_counterparty_count=0,
                 daily_stat_date=date(2026, 7, 21), feature_event_time=datetime(2026, 7, 21, 8, tzinfo=timezone.utc)).first()
    assert row.correlation_id == "corr-1" and row.cost_ms is None and row.created_at is not None
    assert row.feature_snapshot == {
        "daily_stat_date": "20260721", "daily_amount": "7", "daily_count": "1", "txn_count_5m": "2", "device_new": "true",
        "known_device_count": "1", "unique_counterparty_count": "0", "feature_event_time": "1784620800000",
    }
    blank = decide(spark, correlation_id="\t").first()
    assert blank.correlation_id == blank.decision_id


@pytest.mark.parametrize("text,blank", [("", True), (" ", True), ("\t", True), ("\n\x0b\x1c", True), ("\u2003", True), ("\u00a0", False), ("a ", False), (None, True)])
def test_blank_is_any_white_space(spark, text, blank):
    row = spark.createDataFrame([(text,)], "t string").select(is_blank(F.col("t")).alias("b"), hmac_sha256(F.col("t"), "k").alias("h")).first()
    assert row.b == blank and (row.h is None) == blank


def test_record_holds_no_raw_account(spark):
    row = dec.records(decide(spark)).first()
    assert BASE["account_no"] not in str(row)
    assert row.account_token == hmac.new(b"k", BASE["account_no"].encode(), hashlib.sha256).hexdigest()


def test_cases_only_for_review_and_challenge(spark):
    assert dec.open_cases(decide(spark, amount_minor=6_000_000)).first().status == "OPEN"
    assert dec.open_cases(decide(spark, blacklist=True)).count() == 0


def test_new_only_skips_stored(spark):
    decided = decide(spark)
    assert dec.new_only(decided, decided).count() == 0


@pytest.mark.parametrize("rollout,version", [(0, "v1"), (100, "v2")])
def test_canary_extremes(spark, rollout, version):
    df = spark.createDataFrame([("s", f"t{i}") for i in range(50)], "source_id string, txn_id string")
    assert {r.version for r in rules.canary(df, rollout, "v2", "v1").collect()} == {version}


def test_bucket_equals_signed_polynomial_hash(spark):
    def text_hash(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) % 2**32
        return h

    pairs = [("MOBILE_TRANSFER", f"t-{i}") for i in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("bucket", key_bucket(F.col("a"), F.col("b")))
    for r in df.collect():
        h = ((31 + text_hash(r.a)) * 31 + text_hash(r.b)) % 2**32
        assert r.bucket == (h - 2**32 if h >= 2**31 else h) % 100


def test_binding_needs_previous_for_partial_rollout():
    with pytest.raises(ValueError):
        rules.Binding(("model",), "v2", rollout=50)


def test_read_tiers(spark, tmp_path):
    path = tmp_path / "tiers.csv"
    path.write_text(
        'RuleSet,rules\nImport,"a.B,c.D"\n,,,,,\nRuleTable Tier,,,,,\nCONDITION,CONDITION,CONDITION,CONDITION,ACTION,AGENDA-GROUP\n'
        'T,T,T,r:R,,\n"channel == ""$param""",amount >= $param,amount < $param,,"r.tier(""$param"");",\n'
        "channel,from,to,object,code,set\nWEB,1,5,this != null,DT_X,threshold\nIT'S,5,9,this != null,DT_Y,threshold\n"
    )
    tiers = rules.read_tiers(spark, str(path))
    assert tiers == (rules.Tier("IT'S", 5, 9, "DT_Y"), rules.Tier("WEB", 1, 5, "DT_X"))
    df = spark.createDataFrame([("IT'S", 5), ("WEB", 5)], "channel string, amount_minor bigint")
    hits = rules.rule_hits(df, rules.tier_rules(tiers)).select(rules.codes_of(F.col("hits")).alias("c")).collect()
    assert [r.c for r in hits] == [["DT_Y"], []]


def test_shadow_reports_only_differences(spark):
    df = spark.createDataFrame([(1, 10), (2, 60)], "id int, amount_minor int")
    active = [rules.Rule("BIG", "threshold", "HIGH", "amount_minor > 100")]
    shadow = [rules.Rule("BIG", "threshold", "HIGH", "amount_minor > 50")]
    (row,) = rules.shadow_diff(df, active, shadow).collect()
    assert (row.id, row.active_level, row.shadow_level) == (2, "LOW", "HIGH")


def test_text_functions(spark):
    df = spark.createDataFrame([("6225000000000001", " 12 ", "TRUE"), ("123", "12.0", "x"), ("  ", None, None)], "a string, n string, b string")
    rows = df.select(
        hmac_sha256(F.col("a"), "k").alias("h"), mask_middle(F.col("a")).alias("m"), mask_tail(F.col("a")).alias("t"),
        text_to_long(F.col("n")).alias("n"), text_to_bool(F.col("b")).alias("b"),
    ).collect()
    assert rows[0].h == hmac.new(b"k", b"6225000000000001", hashlib.sha256).hexdigest() and rows[2].h is None
    assert (rows[0].m, rows[1].m) == ("622500******0001", "123")
    assert (rows[0].t, rows[1].t) == ("****0001", "****")
    assert [r.n for r in rows] == [12, 0, 0] and [r.b for r in rows] == [True, False, False]


def test_contract_rules(spark):
    good = '{"metadata":{"eventId":"e","correlationId":"c","sourceId":"s","txnId":"t","occurredAt":"2026-07-22T01:00:00Z","schemaVersion":%d},' \
        '"channel":"WEB","bizType":"TRANSFER","accountNo":"a","amountMinor":%d,"currency":"CNY","eventTime":"2026-07-22T01:00:00Z","extra":1}'  # fmt: skip
    texts = [good % (1, 5), good % (2, 5), good % (1, 0), good[:30], "not json", None]
    df = spark.createDataFrame([("transaction.v1", 0, i, "k", t) for i, t in enumerate(texts)], "topic string, partition int, offset bigint, key string, payload string")
    valid, rejected = contracts.validate_contract(contracts.parse_transactions(df))
    assert [(r.offset, r.status) for r in valid.collect()] == [(0, "UNKNOWN")]
    assert {r.offset: r.violations for r in rejected.collect()} == {
        1: ["schema_version must be 1"], 2: ["amount_minor must be positive"], 3: ["malformed"], 4: ["malformed"], 5: ["malformed"],
    }
    letter = contracts.dead_letters(rejected.filter("offset = 1")).first()
    assert (letter.event_id, letter.original_topic) == ("dlt-transaction.v1.DLT-0-1", "transaction.v1")


def test_event_time_bounds_are_valid(spark):
    times = ["2026-04-23 00:00:00", "2026-04-22 23:59:59", "2026-07-22 00:05:00", "2026-07-22 00:05:01"]
    df = spark.createDataFrame([(t,) for t in times], "event_time string").withColumn("event_time", F.col("event_time").cast("timestamp"))
    out = contracts.event_time_reason(df, F.lit("2026-07-22 00:00:00").cast("timestamp")).collect()
    assert [r.time_violation for r in out] == [None, "TOO_OLD", None, "IN_FUTURE"]
