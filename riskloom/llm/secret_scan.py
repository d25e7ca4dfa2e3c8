"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression, from which a Boolean query over trigrams is derived (``trigrams.py``):
a disjunction of alternatives, each a set of trigrams that all occur in any match. The index lists, per
trigram, the documents whose lower-cased text holds it; intersecting the lists of an alternative gives
candidate documents, and only these are scanned with the expression. A rule without mandatory
trigrams scans every document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, put_back, set_aside
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    ``pattern`` is a Java regular expression. ``group`` has at least ``least`` characters in a
    match that counts; other matches are dropped, though they use up their text.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def query(self) -> tuple[frozenset[str], ...]:
        """The trigrams of each alternative; empty if nothing is mandatory."""
        return trigram_query(self.pattern)


BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)

#: Further kinds whose spans are added to those above.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

RULES = BASE_RULES + MORE_RULES


def trigrams(rules: Sequence[Rule]) -> list[str]:
    return sorted({t for r in rules for alternative in r.query for t in alternative})


def trigram_index(docs: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Postings (trigram, doc): which documents hold each wanted trigram, letters in either case."""
    text = F.lower("text")
    held = F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in wanted])
    return docs.select(F.col("doc"), F.explode(F.array_compact(held)).alias("trigram"))


def candidates(postings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per document, the rules of which some alternative has all its trigrams in the index.

    Lists are intersected by grouping the postings on the document, where each alternative asks for
    as many different trigrams as it has.
    """
    queries = [(r.kind, alternative) for r in rules for alternative in r.query]
    hits = postings.groupBy("doc").agg(
        *[
            F.count_if(F.col("trigram").isin(*sorted(alternative))).alias(f"_{i}")
            for i, (_, alternative) in enumerate(queries)
        ]
    )

    def kind(name: str) -> Column:
        tests = [F.col(f"_{i}") == len(a) for i, (k, a) in enumerate(queries) if k == name]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return F.when(out, F.lit(name))

    named = [kind(k) for k in dict.fromkeys(k for k, _ in queries)]
    return hits.select("doc", F.array_compact(F.array(*named)).alias("rules")).filter(F.size("rules") > 0)


def matches(text: Column, rule: Rule) -> Column:
    """Spans of the rule in a text: (start, end) in code points, leftmost and not overlapping.

    What lies between matches comes from splitting at the same expression, so adding up lengths gives
    the positions.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    long_enough = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), long_enough.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"))
        spans = F.when(F.length(part["value"]) >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(parts, start, step, lambda s: s["spans"])


def _tag(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _scanned(docs: DataFrame, rules: Sequence[Rule], text: str) -> DataFrame:
    """The rows set aside, with ``_spans``."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    aside = set_aside(docs, text, _doc=F.struct(F.col("doc_id"), F.xxhash64(body).alias("h")))
    keyed = aside.withColumn("_text", F.coalesce(F.col("_body").cast("string"), F.lit("")))
    indexed = [r for r in rules if r.query]
    postings = materialize(
        trigram_index(keyed.select(F.col("_doc").alias("doc"), F.col("_text").alias("text")), trigrams(rules)).distinct(),
        "trigram-postings",
    )
    found = candidates(postings, indexed).select(F.col("doc").alias("_found"), F.col("rules").alias("_rules"))
    joined = keyed.join(found, F.col("_doc").eqNullSafe(F.col("_found")), "left")

    spans = []
    for order, rule in enumerate(rules):
        none = F.array().cast("array<struct<start:int,end:int>>")
        scanned = matches(F.col("_text"), rule)
        if rule.query:
            scanned = F.when(F.array_contains("_rules", rule.kind), scanned).otherwise(none)
        else:
            scanned = F.when(F.col("_text").rlike(rule.pattern), scanned).otherwise(none)
        tagged = F.transform(scanned, _tag(order, rule.kind))
        spans.append(tagged)
    ordered = F.array_sort(F.concat(*spans))
    out = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.withColumn("_spans", out)


def secret_scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The input rows with ``spans``: array of (kind, start, end) by start, then in the order of the rules.

    Null texts count as empty and have no spans, as have empty tables no rows. Documents are told
    apart by id and text, so rows that repeat both get the same spans; null ids are allowed. Texts are scanned
    whole, whatever their length. An input column ``spans`` is replaced; all others are kept.
    """
    out = _scanned(docs, rules, text)
    columns = [c for c in docs.columns if c != "spans"]
    return out.select(*put_back(out, columns, text), F.col("_spans").alias("spans"))


def redact_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The input rows, columns as they are, with every secret of the text replaced by ``[kind]``; null texts stay null."""
    out = _scanned(docs, rules, text)
    return out.select(*put_back(out, docs.columns, text, _redacted(F.col("_body"), F.col("_spans"))))


def _redacted(body: Column, spans: Column) -> Column:
    """Spans replaced by their kinds in brackets; where spans overlap, the first one names the stretch."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(body, state["at"] + 1, span["start"] - state["at"])
        mark = F.concat(F.lit("["), span["kind"], F.lit("]"))
        fresh = span["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], gap, mark)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(body, s["at"] + 1, F.length(body)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(body)


def redact(scanned: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span of ``secret_scan`` by ``[kind]``."""
    return scanned.withColumn(text, _redacted(F.col(text), F.col("spans")))


def span_digest(scanned: DataFrame, base: Sequence[Rule] = BASE_RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as one text."""
    kinds = [r.kind for r in base]
    show = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of_base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return scanned.select(
        "doc_id",
        *[_count(k) for k in kinds],
        F.sha2(F.array_join(F.transform(of_base, show), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", show), ",").alias("spans"),
    )
