"""From scored transactions to decision records, events and cases."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hmac_sha256, non_blank
from ..sources.tables import envelope_struct
from .common import first_per
from .rules import BASELINE, RULES, TIERS, Binding, Rule, action_of, bind_rule_sets, codes_of, hit_structs, level_of, tier_rules

RECORD = [
    "decision_id",
    "source_id",
    "txn_id",
    "correlation_id",
    "event_time",
    "account_token",
    "risk_level",
    "action",
    "fraud_score",
    "hit_rules",
    "feature_snapshot",
    "rule_version",
    "model_version",
    "cost_ms",
    "created_at",
]
ALL_RULES: tuple[Rule, ...] = RULES + tier_rules(TIERS)
BINDINGS = {source: Binding(BASELINE, "baseline-1") for source in ("MOBILE_TRANSFER", "WEB_BANK", "ATM_NET")}


def decision_id() -> Column:
    """One decision per source and transaction, so its id is a hash of both."""
    return F.sha2(F.concat_ws("|", "source_id", "txn_id"), 256)


def decide(
    as_of: DataFrame,
    key: str,
    scorer: Callable[[DataFrame], DataFrame],
    rules: Sequence[Rule] = ALL_RULES,
    bindings: dict[str, Binding] = BINDINGS,
    model_version: str = "fraud-1",
    created_at: Column | None = None,
    cost_ms: Column | None = None,
) -> DataFrame:
    """Add the decision to transactions that carry features as of their time.

    ``scorer`` adds ``fraud_score``. A transaction's own ``correlation_id`` is kept; without one (no column,
    null or blank) the decision's id correlates. ``created_at`` is the clock, by default the current time, and
    ``cost_ms`` what the evaluation took, by default unknown.

    Without published rules for the source the decision degrades to HIGH; else, where the feature
    store was unavailable, to MEDIUM. Missing features of an available store are simply absent.
    """
    df = bind_rule_sets(scorer(as_of), bindings)
    unbound = F.col("rule_version").isNull()
    blind = ~F.col("features_available")
    normal = ~(unbound | blind)
    df = df.withColumn("hits", F.when(normal, hit_structs(rules, F.col("rule_sets"))))
    # names and forms of the feature contract: days as digits, times in milliseconds
    snapshot = {
        "daily_stat_date": F.date_format("daily_stat_date", "yyyyMMdd"),
        "daily_amount": F.col("daily_amount").cast("string"),
        "daily_count": F.col("daily_count").cast("string"),
        "txn_count_5m": F.col("txn_count").cast("string"),
        "device_new": F.col("device_new").cast("string"),
        "known_device_count": F.col("known_device_count").cast("string"),
        "unique_counterparty_count": F.col("unique_counterparty_count").cast("string"),
        "feature_event_time": F.unix_millis("feature_event_time").cast("string"),
    }
    given = non_blank(F.col("correlation_id")) if "correlation_id" in as_of.columns else F.lit(None).cast("string")
    entries = F.create_map(*[part for c, value in snapshot.items() for part in (F.lit(c), value)])
    df = df.withColumns(
        {
            "decision_id": decision_id(),
            "correlation_id": F.coalesce(given, decision_id()),
            "account_token": hmac_sha256(F.col("account_no"), key),
            "risk_level": F.when(unbound, "HIGH").when(blind, "MEDIUM").otherwise(level_of(F.col("hits"))),
            "fraud_score": F.when(normal, F.col("fraud_score")).otherwise(0.0),
            "hit_rules": F.when(unbound, F.array(F.lit("DEGRADED_ENGINE_UNAVAILABLE")))
            .when(blind, F.array(F.lit("DEGRADED_FEATURE_UNAVAILABLE")))
            .otherwise(codes_of(F.col("hits"))),
            "feature_snapshot": F.map_filter(entries, lambda k, v: v.isNotNull() & ~blind),
            "model_version": F.when(unbound, "unavailable").when(blind, "not-evaluated").otherwise(model_version),
            "rule_version": F.coalesce("rule_version", F.lit("unavailable")),
            "cost_ms": (F.lit(None) if cost_ms is None else cost_ms).cast("bigint"),
            "created_at": F.current_timestamp() if created_at is None else created_at,
        }
    )
    return df.withColumn("action", action_of(F.col("risk_level"))).drop("hits", "rule_sets")


def records(decided: DataFrame) -> DataFrame:
    """The stored decision record; raw accounts stay behind."""
    return decided.select(*RECORD)


def idempotent(decisions: DataFrame) -> DataFrame:
    """The first decision of each source and transaction."""
    return first_per(decisions, ["source_id", "txn_id"], ["created_at", "decision_id"])


def new_only(decisions: DataFrame, stored: DataFrame) -> DataFrame:
    """Decisions whose transaction has none stored yet."""
    return idempotent(decisions).join(stored.select("source_id", "txn_id"), ["source_id", "txn_id"], "left_anti")


def contract_level(level: Column) -> Column:
    return F.when(level == "REJECT", "CRITICAL").otherwise(level)


def decision_event() -> Column:
    """The nested decision event of one decided row."""
    iso = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.struct(
        F.struct(
            F.sha2(F.concat_ws("|", "decision_id", F.lit("decision.v1")), 256).alias("eventId"),
            F.col("correlation_id").alias("correlationId"),
            F.col("source_id").alias("sourceId"),
            F.col("txn_id").alias("txnId"),
            iso.alias("occurredAt"),
            F.lit(1).alias("schemaVersion"),
        ).alias("metadata"),
        F.col("decision_id").alias("decisionId"),
        contract_level(F.col("risk_level")).alias("riskLevel"),
        F.col("action"),
        F.col("fraud_score").alias("fraudScore"),
        F.transform(
            "hit_rules",
            lambda c: F.struct(c.alias("ruleCode"), c.alias("ruleName"), F.lit(0).alias("score"), c.alias("reason")),
        ).alias("hitRules"),
        F.col("feature_snapshot").alias("featureSnapshot"),
        F.col("rule_version").alias("ruleVersion"),
        F.col("model_version").alias("modelVersion"),
        F.col("cost_ms").alias("costMs"),
    )


def outbox(decided: DataFrame) -> DataFrame:
    """Two messages per decision, transaction first, both keyed by account."""

    def message(kind: str, aggregate_id: str, topic: str, payload: Column) -> Column:
        return F.struct(
            F.sha2(F.concat_ws("|", "decision_id", F.lit(topic)), 256).alias("event_id"),
            F.lit(kind).alias("aggregate_type"),
            F.col(aggregate_id).alias("aggregate_id"),
            F.lit(topic).alias("topic"),
            F.col("account_no").alias("message_key"),
            F.to_json(payload).alias("payload"),
            F.col("created_at").alias("created_at"),
        )

    both = F.array(
        message("Transaction", "txn_id", "transaction.v1", envelope_struct()),
        message("Decision", "decision_id", "decision.v1", decision_event()),
    )
    return decided.select(F.explode(both).alias("m")).select("m.*")


def open_cases(decisions: DataFrame) -> DataFrame:
    """A case per decision that needs a person."""
    return decisions.filter(F.col("action").isin("REVIEW", "CHALLENGE")).select(
        F.sha2(F.concat_ws("|", "decision_id", F.lit("case")), 256).alias("case_id"),
        "decision_id",
        "source_id",
        "txn_id",
        "risk_level",
        F.lit("OPEN").alias("status"),
        F.lit(0).cast("bigint").alias("version"),
        F.col("created_at"),
        F.col("created_at").alias("updated_at"),
    )


def rule_effect(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Per rule: hits, share of all decisions, labelled hits and the confirmed-fraud share of those."""
    fraud = F.when(F.col("label") == "FRAUD", 1).when(F.col("label").isNotNull(), 0)
    # a decision without hits gives one row without a rule, so first rows count the decisions
    rows = decisions.select("source_id", "txn_id", F.posexplode_outer("hit_rules").alias("pos", "rule"))
    per_rule = (
        rows.join(labels.select("source_id", "txn_id", "label"), ["source_id", "txn_id"], "left")
        .groupBy("rule")
        .agg(
            F.count(F.lit(1)).alias("hits"),
            F.count(F.when(F.coalesce("pos", F.lit(0)) == 0, 1)).alias("_firsts"),
            F.count(fraud).alias("labelled"),
            F.sum(fraud).alias("_fraud"),
        )
    )
    total = F.sum("_firsts").over(Window.partitionBy(F.lit(0)))  # one row per rule
    return (
        per_rule.withColumn("hit_ratio", F.col("hits") / total)
        .filter(F.col("rule").isNotNull())
        .select(
            "rule",
            "hits",
            "hit_ratio",
            "labelled",
            F.when(F.col("labelled") > 0, F.col("_fraud") / F.col("labelled")).otherwise(0.0).alias("fraud_rate"),
        )
    )


def intercepts(decisions: DataFrame, as_of: Column, days: int = 30, actions: Sequence[str] = ("REJECT",)) -> DataFrame:
    """Per account token: how often it was stopped in the days before ``as_of``."""
    recent = decisions.filter((F.col("created_at") <= as_of) & (F.col("created_at") > as_of - F.lit(timedelta(days=days))))
    return recent.filter(F.col("action").isin(*actions)).groupBy("account_token").agg(F.count(F.lit(1)).alias("intercepts"))
