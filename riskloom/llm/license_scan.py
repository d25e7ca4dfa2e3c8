"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes words, and the words that any rule needs are looked up in it once. Only rules all of whose words
are present are tried, each with one pass of its expression over the normalised text. Detections are
intervals of words. Then overlaps are resolved: a detection inside that of a rule of an earlier or the same
kind is dropped, whatever it says; so the full notice beats the name in it, and the name with a version
beats the name without. The base phrases are counted apart and neither drop others nor are dropped.

The text is read in one pass without a shuffle; only the detections are, by document, as three numbers each.
Running numbers over them are window functions, so a document with very many detections is sorted, not
compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .license_rules import BASE, KINDS, RULES, WORTH, Rule, compiled

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Marks around a match; neither can stand in normalised text.
_OPEN, _CLOSE = "\x01", "\x02"


def base_rules() -> list[Rule]:
    """The base phrases as rules of a kind behind all others."""
    return [Rule(label, len(KINDS), tuple(phrase.split(" ")), compiled(phrase)) for label, phrase in BASE]


def _words(part: Column) -> Column:
    """Words of a stretch of normalised text: each has a blank on either side."""
    blanks = F.octet_length(part) - F.octet_length(F.replace(part, F.lit(" "), F.lit("")))
    return F.shiftright(blanks, 1)


def _found(rules: list[Rule]) -> Column:
    """The matches in ``_normal`` of all rules whose words are in ``_known``: (rule, k, words, after), ``after`` being
    the words up to the rule's next match. The entry with k = 0 is what lies before the first one."""
    table = F.array(
        *[
            F.struct(F.lit(i).alias("rule"), F.array(*map(F.lit, r.need)).alias("need"), F.lit(r.pattern).alias("pattern"))
            for i, r in enumerate(rules)
        ]
    )

    def matches(r: Column) -> Column:
        marked = F.regexp_replace(F.col("_normal"), r["pattern"], F.lit(f"{_OPEN}$0{_CLOSE}"))

        def hit(piece: Column, k: Column) -> Column:
            own = F.when(k == 0, 0).otherwise(_words(F.substring_index(piece, _CLOSE, 1)))
            return F.struct(r["rule"].alias("rule"), k.alias("k"), own.alias("words"), (_words(piece) - own).alias("after"))

        return F.transform(F.split(marked, _OPEN, -1), hit)

    tried = F.filter(table, lambda r: F.size(F.array_except(r["need"], F.col("_known"))) == 0)
    return F.flatten(F.filter(F.transform(tried, matches), lambda hits: F.size(hits) > 1))


def _lookup(values: list) -> Column:
    return F.array(*map(F.lit, values))


def detections(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (row, doc_id, n_words), and their detections (row, rule, kind, start, end, kept).

    ``rules`` are in order of precedence. ``end`` is exclusive; ``kept`` is false for what a rule of an earlier or
    the same kind contains. Kinds from ``len(KINDS)`` on stand outside of this. A rule's own matches don't
    overlap, the leftmost one counts.
    """
    rules = [*RULES, *base_rules()] if rules is None else rules
    wanted = sorted({w for r in rules for w in r.need})
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_remove(F.split(lowered, BETWEEN), "").alias("_words"))
    rows = rows.withColumn("_known", F.array_intersect("_words", _lookup(wanted)))
    some = F.size("_known") > 0
    rows = rows.withColumn("_normal", F.when(some, F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" "))))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.when(some, _found(rules)).alias("found"),
    )
    rows = materialize(rows, "license-found")
    hits = rows.filter(F.size("found") > 0).select("row", F.explode("found").alias("x")).select("row", "x.*").repartition("row")
    earlier = Window.partitionBy("row", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum(F.col("words") + F.col("after")).over(earlier)
    kind = F.get(_lookup([r.kind for r in rules]), F.col("rule"))
    placed = hits.select("row", "rule", "k", kind.alias("kind"), start.alias("start"), "words").filter("k > 0")
    placed = placed.select("row", "rule", "kind", "start", (F.col("start") + F.col("words")).alias("end"))
    # whatever contains an interval comes before it in this order, and reaches as far
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("kind") <= k, F.col("end"))).over(order) for k in range(len(KINDS))]
    inside = F.lit(False)
    for k, furthest in enumerate(reach):
        inside = F.when(F.col("kind") == k, F.coalesce(furthest >= F.col("end"), F.lit(False))).otherwise(inside)
    return rows.drop("found"), placed.withColumn("kept", ~inside)


def license_scan(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of letters a-z and digits, A-Z lower-cased, and of all characters beyond ASCII. ``n_base``
    counts the places of the base phrases, ``first_word`` and ``last_word`` are their smallest and largest
    starts (null without any). ``labels`` are those of the base and of the detections that are kept, ``score`` is the
    largest worth of these detections, 0 without any. Null texts count as empty; they have no words
    and no labels (empty strings). Repeated rows and ids, null ids too, give a row each. Texts are read
    whole, whatever their length. Other columns are not read; an empty table gives no rows.
    """
    rules = [*RULES, *base_rules()] if rules is None else rules
    rows, found = detections(docs, rules, text)
    label = F.get(_lookup([r.label for r in rules]), F.col("rule"))
    worth = F.get(_lookup([WORTH[r.kind] if r.kind < len(WORTH) else 0.0 for r in rules]), F.col("rule"))
    base = F.col("kind") >= len(KINDS)

    def joined(labels: Column) -> Column:
        return F.array_join(F.sort_array(labels), ",")

    per_row = (
        found.filter("kept")
        .groupBy("row")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            joined(F.collect_set(F.when(base, label))).alias("base_labels"),
            joined(F.collect_set(label)).alias("labels"),
            F.max(worth).alias("score"),
        )
    )
    none = F.lit("")
    return rows.join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
