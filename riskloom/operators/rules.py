"""Rules held as data and compiled to one projection per row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_bucket
from ..sources.schemas import RISK_LEVELS


@dataclass(frozen=True)
class Rule:
    """A code and level given where a predicate (SQL, or a function that builds a column) holds; it fires
    only if its set is bound."""

    code: str
    rule_set: str
    level: str
    predicate: str | Callable[[], Column]

    def holds(self) -> Column:
        return F.expr(self.predicate) if isinstance(self.predicate, str) else self.predicate()


@dataclass(frozen=True)
class Tier:
    """A decision-table line: the code for a channel and an amount in [low, high)."""

    channel: str
    low: int
    high: int
    code: str


@dataclass(frozen=True)
class Binding:
    """The rule sets published for a source, and the release before for a partial rollout."""

    rule_sets: tuple[str, ...]
    version: str
    rollout: int = 100
    previous_sets: tuple[str, ...] = ()
    previous_version: str | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.rollout <= 100:
            raise ValueError("rollout is a percentage")
        if self.rollout < 100 and self.previous_version is None:
            raise ValueError("a rollout below 100 needs the release before")


# The published rules, decision table and rule sets.
RULES = (
    Rule("BLACKLIST_ACCOUNT", "blacklist", "REJECT", "blacklist"),
    Rule("BLACKLIST_DEVICE", "blacklist", "REJECT", "device_blacklist"),
    Rule("LARGE_TRANSFER", "threshold", "HIGH", "biz_type = 'TRANSFER' AND amount_minor > 5000000"),
    Rule("DAILY_AMOUNT_EXCEEDED", "threshold", "HIGH", "daily_amount > 10000000"),
    Rule("NEW_DEVICE_MID_AMOUNT", "threshold", "MEDIUM", "amount_minor > 1000000 AND device_new"),
    Rule("HIGH_VELOCITY", "threshold", "HIGH", "txn_count >= 5"),
    Rule("MODEL_HIGH_RISK", "model", "REJECT", "fraud_score > 0.9D"),
    Rule("MODEL_MID_RISK", "model", "HIGH", "fraud_score > 0.6D AND fraud_score <= 0.9D"),
)
TIERS = (
    Tier("MOBILE", 5_000_000, 100_000_000, "DT_MOBILE_LARGE"),
    Tier("MOBILE", 100_000_000, 9_999_999_999, "DT_MOBILE_HUGE"),
    Tier("WEB", 10_000_000, 1_000_000_000, "DT_WEB_LARGE"),
)
BASELINE = ("blacklist", "threshold", "model")
ACTIONS = {"LOW": "ALLOW", "MEDIUM": "CHALLENGE", "HIGH": "REVIEW", "REJECT": "REJECT"}


def read_tiers(spark: SparkSession, path: str) -> tuple[Tier, ...]:
    """Decision-table lines from a rule sheet (CSV) that Spark can read.

    The sheet's head names its columns' roles (CONDITION, ACTION, AGENDA-GROUP); lines of the table follow the row of titles
    below the parameter patterns and hold channel, lower and upper amount, an object test, the code and the rule set.
    """
    names = ["channel", "low", "high", "test", "code", "rule_set"]
    lines = spark.read.schema(", ".join(f"{n} string" for n in names)).option("quote", '"').option("escape", '"').csv(path)
    whole = "^[0-9]+$"
    rows = lines.filter(F.col("low").rlike(whole) & F.col("high").rlike(whole) & F.col("code").isNotNull())
    return tuple(Tier(r.channel, int(r.low), int(r.high), r.code) for r in rows.orderBy("channel", F.col("low").cast("bigint"), "code").collect())


def _in_tier(t: Tier) -> Callable[[], Column]:
    return lambda: (F.col("channel") == t.channel) & (F.col("amount_minor") >= t.low) & (F.col("amount_minor") < t.high)


def tier_rules(tiers: Sequence[Tier]) -> tuple[Rule, ...]:
    """Decision-table lines as rules of the threshold set."""
    return tuple(Rule(t.code, "threshold", "HIGH", _in_tier(t)) for t in tiers)


def hit_structs(rules: Sequence[Rule], rule_sets: Column | None = None) -> Column:
    """Array of (code, severity) of the rules that fire, sorted by code."""

    def fired(r: Rule) -> Column:
        holds = r.holds()
        if rule_sets is not None:
            holds = holds & F.array_contains(rule_sets, r.rule_set)
        return F.when(holds, F.struct(F.lit(r.code).alias("code"), F.lit(RISK_LEVELS.index(r.level)).alias("severity")))

    return F.sort_array(F.array_distinct(F.array_compact(F.array(*[fired(r) for r in rules]))))


def rule_hits(df: DataFrame, rules: Sequence[Rule] = RULES, rule_sets: Column | None = None) -> DataFrame:
    """Add ``hits``; all rules are evaluated in one pass over the row."""
    return df.withColumn("hits", hit_structs(rules, rule_sets))


def level_of(hits: Column) -> Column:
    """The highest level among the hits, LOW without any."""
    severity = F.coalesce(F.array_max(hits["severity"]), F.lit(0))
    return F.element_at(F.array(*[F.lit(level) for level in RISK_LEVELS]), severity + 1)


def codes_of(hits: Column) -> Column:
    return hits["code"]


def action_of(level: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, action in ACTIONS.items():
        out = out.when(level == name, action)
    return out


def escalate(df: DataFrame) -> DataFrame:
    """Turn ``hits`` into ``risk_level``, ``action`` and the code list ``hit_rules``."""
    leveled = df.withColumn("risk_level", level_of(F.col("hits"))).withColumn("hit_rules", codes_of(F.col("hits")))
    return leveled.withColumn("action", action_of(F.col("risk_level"))).drop("hits")


def canary(df: DataFrame, rollout: int, active: str, previous: str) -> DataFrame:
    """Add the stable ``bucket`` of the transaction and the version it is routed to."""
    bucket = key_bucket(F.col("source_id"), F.col("txn_id"))
    return df.withColumn("bucket", bucket).withColumn(
        "version", F.when(F.col("bucket") >= rollout, previous).otherwise(active)
    )


def bind_rule_sets(df: DataFrame, bindings: dict[str, Binding]) -> DataFrame:
    """Add ``rule_sets`` and ``rule_version`` published for the source; null where nothing is."""
    sets, version = F.when(F.lit(False), F.array(F.lit(""))), F.when(F.lit(False), F.lit(""))
    for source, b in bindings.items():
        here = F.col("source_id") == source
        if b.rollout < 100:
            old = here & (key_bucket(F.col("source_id"), F.col("txn_id")) >= b.rollout)
            sets = sets.when(old, F.array(*[F.lit(s) for s in b.previous_sets]))
            version = version.when(old, F.lit(b.previous_version))
        sets = sets.when(here, F.array(*[F.lit(s) for s in b.rule_sets]))
        version = version.when(here, F.lit(b.version))
    return df.withColumn("rule_sets", sets).withColumn("rule_version", version)


def shadow_diff(df: DataFrame, active: Sequence[Rule], shadow: Sequence[Rule]) -> DataFrame:
    """Rows whose level or hits would differ under the shadow rules."""
    both = df.withColumn("_a", hit_structs(active)).withColumn("_s", hit_structs(shadow))
    out = both.select(
        *df.columns,
        level_of(F.col("_a")).alias("active_level"),
        level_of(F.col("_s")).alias("shadow_level"),
        codes_of(F.col("_a")).alias("active_hits"),
        codes_of(F.col("_s")).alias("shadow_hits"),
    )
    same = F.col("active_level").eqNullSafe(F.col("shadow_level")) & F.col("active_hits").eqNullSafe(F.col("shadow_hits"))
    return out.filter(~same)
