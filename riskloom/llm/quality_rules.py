"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one document: words, symbols, repeated lines, repeated 8-word windows. The
cross-document rule hashes normalised lines, counts the documents of a host that hold each line, and
removes lines above the limits from every document but the first that shows them. A document of
which too little is left is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, put_back, set_aside

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: A line is boilerplate of its host from this many documents on, if they are this share of the host's.
MIN_DOCS = 20
MAX_SHARE = 0.05
#: A document is depleted when less than this share of its line characters is left.
MIN_LEFT = 0.3


def line_hash(line: Column) -> Column:
    """Hash of a line without outer blanks, letters in one case."""
    return F.xxhash64(F.lower(F.trim(line)))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def _repeated_words() -> Column:
    """Words inside windows found twice or more: sort the window hashes, keep the starts that have an
    equal neighbour, and add up what their windows cover."""
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(x: Column, i: Column) -> Column:
        before, after = F.get("_ordered", i - 1)["h"], F.get("_ordered", i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter("_ordered", repeated), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(s: Column, i: Column) -> Column:
        end = i + WINDOW
        return F.struct(end.alias("end"), (s["n"] + end - F.greatest(s["end"], i)).alias("n"))

    return ordered, F.aggregate(starts, zero, cover, lambda s: s["n"])


def profile(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """One row per document with the base figures and its lines as (hash, characters)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        body.alias("_text"),
    )
    symbols = sum((F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
    rows = rows.select(
        "doc_id",
        "host",
        F.xxhash64("_text").alias("text_hash"),
        symbols.cast("long").alias("n_symbols"),
        F.array_remove(F.split("_text", WHITE), "").alias("_words"),
        _lines(F.col("_text")).alias("_lines"),
    )
    rows = rows.select(
        "doc_id",
        "host",
        "text_hash",
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        F.transform("_lines", lambda x: F.struct(line_hash(x).alias("h"), F.length(F.trim(x)).alias("chars"))).alias("lines"),
    )
    starts = F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice("_hashes", i, F.lit(WINDOW))))
    rows = rows.withColumn("_windows", F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<long>")))
    ordered, covered = _repeated_words()
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_ordered", F.when(some, ordered))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_ordered").isNotNull(), covered), F.lit(0).cast("long")))
    return rows.drop("_hashes", "_windows", "_ordered").withColumn("rid", F.monotonically_increasing_id())


def frequent_lines(profiles: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Lines above the limits: host, h, and the id of the first document that shows the line."""
    lines = profiles.select("host", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    hosts = profiles.groupBy("host").agg(F.count("*").alias("docs"))
    return (
        counts.filter(F.col("n") >= min_docs)
        .join(hosts, "host")
        .filter(F.col("n") > F.col("docs") * F.lit(max_share))
        .select("host", "h", "first")
    )


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """One row per document: the base figures, ``base_failed``, ``left_share``, ``removed`` (hashes of
    the lines taken out) and ``kept``.

    Null texts count as empty and fail the base rules; a null host is a host of its own. Every row
    counts as a document, also where ids repeat; rows that share the smallest id of a line all count
    as its first document. An empty table gives no rows; other columns are not read.
    """
    rows = materialize(profile(docs, text, host), "quality-profiles")
    over = materialize(frequent_lines(rows, min_docs, max_share), "quality-lines")
    lines = rows.select("rid", "host", "doc_id", F.explode("lines").alias("line")).select(
        "rid", "host", "doc_id", F.col("line.h").alias("h"), F.col("line.chars").alias("chars")
    )
    gone = (
        lines.join(over, ["host", "h"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("rid")
        .agg(F.sum("chars").alias("gone"), F.collect_set("h").alias("removed"))
    )
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    left = 1 - F.coalesce(F.col("gone"), F.lit(0)) / F.greatest(total, F.lit(1))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.join(gone, "rid", "left").select(
        "doc_id",
        "host",
        "text_hash",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        left.alias("left_share"),
        F.coalesce("removed", F.array().cast("array<long>")).alias("removed"),
        (~failed & (left >= min_left)).alias("kept"),
    )


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source", **limits: float) -> DataFrame:
    """The documents that pass, without the lines above the limits; columns as in the input.

    Rows that repeat id, host and text share one verdict: they stay if one of them would.
    """
    verdicts = quality_rules(docs, text, host, **limits).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("text_hash").alias("_hash"), F.col("removed").alias("_removed")
    ).dropDuplicates(["_id", "_host", "_hash"])
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    aside = set_aside(
        docs, text, _doc=F.col("doc_id").cast("long"), _of=F.coalesce(F.col(host).cast("string"), F.lit("")), _th=F.xxhash64(body)
    )
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_host")) & (F.col("_th") == F.col("_hash"))
    left = F.filter(F.split("_body", "\n", -1), lambda x: ~(x.rlike(WORD) & F.array_contains("_removed", line_hash(x))))
    cleaned = F.when(F.size("_removed") > 0, F.array_join(left, "\n")).otherwise(F.col("_body"))
    return aside.join(verdicts, same).select(*put_back(aside, docs.columns, text, cleaned))
