"""Line dedup by winnowing over line hashes, in DataFrame functions only.

The lines of a document (those with a word, outer blanks cut) are hashed, and every ``GRAM`` consecutive
line hashes make a gram. Of every ``WINDOW`` consecutive grams the smallest is a fingerprint, so a run of
``RUN`` = ``GRAM + WINDOW - 1`` equal lines anywhere gives the same fingerprint on both sides: no repeated run
is missed. Fingerprints that occur at several places are joined back to their positions, and matches
are extended both ways: every run of ``RUN`` lines around such a position is looked up, and overlapping
runs that began earlier elsewhere form one maximal repeat. All lines of a later repeat are deleted.

Lines can be whole paragraphs, so a long passage may have fewer than ``RUN`` lines. With ``words`` given, fewer
lines are a run as well if they have that many words together or are all lines of their document; each of these
runs is its own fingerprint.

"Earlier" is the order of (doc_id, place in the document). A run that overlaps its own first occurrence in
the same document loses only the lines beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, put_back, release, set_aside

GRAM = 2
WINDOW = 2
RUN = GRAM + WINDOW - 1
#: Words that make fewer than ``RUN`` lines a passage.
PASSAGE = 50
WORD = r"[^\x20\x09-\x0D]"
_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _count_of(n: Column, width: int) -> Column:
    """0, 1, .. up to the last start of ``width`` of ``n`` things; empty if there are fewer."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def line_profile(docs: DataFrame, text: str = "text", counted: bool = False) -> DataFrame:
    """One row per distinct (doc_id, text): its line hashes and where the lines stand among all lines.

    If ``counted``, also the lines' numbers of words.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), F.split(body, "\n", -1).alias("_all"))

    def place(x: Column, i: Column) -> Column:
        words = F.regexp_count(x, F.lit(WORD + "+")) if counted else x.rlike(WORD).cast("int")
        return F.struct(F.xxhash64(F.regexp_replace(x, _EDGES, "")).alias("h"), i.alias("at"), words.alias("words"))

    rows = rows.select("doc_id", "th", F.filter(F.transform("_all", place), lambda x: x["words"] > 0).alias("_lines"))
    return rows.select("doc_id", "th", *[F.col(f"_lines.{c}").alias(c) for c in ("h", "at", *(["words"] if counted else []))])


def fingerprints(profiles: DataFrame) -> DataFrame:
    """Window minima of the grams: doc_id, th, pos (line number of the gram), fp. Ties go to the later gram."""
    n = F.size("h")
    grams = F.transform(_count_of(n, GRAM), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(GRAM)]))
    rows = profiles.select("doc_id", "th", grams.alias("g"))

    def least(i: Column) -> Column:
        return F.array_min(F.array(*[F.struct(F.get("g", i + k).alias("fp"), (-(i + k)).alias("pos")) for k in range(WINDOW)]))

    chosen = F.array_distinct(F.transform(_count_of(F.size("g"), WINDOW), least))
    return rows.select("doc_id", "th", F.explode(chosen).alias("f")).select("doc_id", "th", (-F.col("f.pos")).alias("pos"), F.col("f.fp").alias("fp"))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"), F.col("pos"))


def _gone(runs: DataFrame, by: list[str], width: Column) -> DataFrame:
    """Lines of the runs that began earlier elsewhere: doc_id, th, line."""
    place = _place()
    first = runs.groupBy(*by).agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = runs.join(first, by).filter(place != F.col("first"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    skip = F.when(own, F.greatest(F.lit(0), F.col("first.pos") + width - F.col("pos"))).otherwise(F.lit(0))
    return later.select("doc_id", "th", F.explode(F.slice("at", skip + 1, width)).alias("line"))


def short_runs(profiles: DataFrame, words: int) -> DataFrame:
    """Runs of fewer than ``RUN`` lines: doc_id, th, pos, width, at, fp.

    They are the lines and groups of lines of ``words`` words, and all lines of documents that have no more;
    the latter meet only each other unless they have the words.
    """
    lines = F.size("h")

    def of(width: int) -> Column:
        def run(i: Column) -> Column:
            long = sum((F.get("words", i + k) for k in range(1, width)), F.get("words", i)) >= words
            fp = F.xxhash64(F.lit(width), long, *[F.get("h", i + k) for k in range(width)])
            return F.struct(
                i.alias("pos"), F.lit(width).alias("width"), F.slice("at", i + 1, width).alias("at"), fp.alias("fp"), (long | (lines == width)).alias("run")
            )

        return F.filter(F.transform(_count_of(lines, width), run), lambda r: r["run"])

    found = profiles.select("doc_id", "th", F.explode(F.concat(*[of(w) for w in range(1, RUN)])).alias("r"))
    return found.select("doc_id", "th", "r.pos", "r.width", "r.at", "r.fp")


def repeated_lines(profiles: DataFrame, words: int | None = None) -> DataFrame:
    """Lines of later repeats, per document: doc_id, th, removed (places among all lines, ascending)."""
    prints = fingerprints(profiles)
    # a fingerprint found at one place only has no match
    several = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "th", "pos")).alias("low"), F.max(F.struct("doc_id", "th", "pos")).alias("high"))
    several = several.filter(~F.col("low").eqNullSafe(F.col("high"))).select("fp")
    hits = prints.join(several, "fp", "left_semi").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("hits"))
    key = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("th") == F.col("_th"))
    marked = profiles.join(hits.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "hits"), key).drop("_id", "_th")
    # runs around the hits, extended both ways as far as a run can reach
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.sequence(F.greatest(F.lit(0), p - (RUN - GRAM)), F.least(p, F.size("h") - RUN)))))
    runs = marked.filter(F.size("h") >= RUN).select("doc_id", "th", "h", "at", F.explode(starts).alias("pos"))
    runs = materialize(
        runs.select("doc_id", "th", "pos", F.slice("at", F.col("pos") + 1, RUN).alias("at"), *[F.get("h", F.col("pos") + k).alias(f"h{k}") for k in range(RUN)]),
        "line-runs",
    )
    gone = _gone(runs, [f"h{k}" for k in range(RUN)], F.lit(RUN))
    if words is not None:
        gone = gone.unionByName(_gone(materialize(short_runs(profiles, words), "line-short"), ["fp", "width"], F.col("width")))
    return gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def _deduped(docs: DataFrame, text: str, words: int | None) -> DataFrame:
    """The rows set aside, with ``_left``, the text without repeated lines, and ``_removed``, the places of these."""
    profiles = materialize(line_profile(docs, text, words is not None).dropDuplicates(["doc_id", "th"]), "line-profiles")
    removed = materialize(repeated_lines(profiles, words), "line-removed")
    release(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    aside = set_aside(docs, text, _doc=F.col("doc_id").cast("long"), _hash=F.xxhash64(body))
    joined = aside.join(
        # always a sort-merge join, so that the plan is the same at every size
        removed.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("removed").alias("_removed")).hint("merge"),
        F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")),
        "left",
    )
    # array_except works with a hash set, so this stays linear in the lines of a document
    places = F.sequence(F.lit(0), F.size("_all") - 1)
    left = F.transform(F.array_except(places, "_removed"), lambda i: F.get("_all", i))
    cleaned = F.when(F.col("_removed").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("_body"))
    out = joined.withColumn("_all", F.when(F.col("_removed").isNotNull(), F.split("_body", "\n", -1))).withColumn("_left", cleaned)
    return out.withColumn("_removed", F.coalesce("_removed", F.array().cast("array<int>")))


def line_dedup(docs: DataFrame, text: str = "text", words: int | None = None) -> DataFrame:
    """The input rows without the lines of later repeats, and with ``removed_lines`` (places, from 0).

    A repeat is a run of at least ``RUN`` lines that began earlier in the order of (doc_id, place); with ``words``,
    also a run of fewer lines that has so many words, and all lines of a document if another of these lines alone was earlier. Null
    ids come last, different texts of one id in the order of their hashes. Rows that repeat id and text are one document and get the
    same result. Lines without a word are never deleted and do not break a run. Null texts stay null;
    an empty table gives no rows. Input columns named ``removed_lines`` are replaced.
    """
    out = _deduped(docs, text, words)
    columns = [c for c in docs.columns if c != "removed_lines"]
    return out.select(*put_back(out, columns, text, F.col("_left")), F.col("_removed").alias("removed_lines"))


def line_digest(deduped: DataFrame, text: str = "text") -> DataFrame:
    """Per document: lines removed, whether any word is left, and the digest of the text that is left."""
    return deduped.select(
        "doc_id",
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.coalesce(F.col(text).rlike(WORD), F.lit(False)).alias("kept"),
        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("kept_sha256"),
    )


def drop_repeated_lines(docs: DataFrame, text: str = "text", words: int | None = None) -> DataFrame:
    """The documents without the lines of later repeats, columns as in the input.

    Documents of which nothing is left, though they had text, are repeats as a whole and go.
    """
    out = _deduped(docs, text, words)
    return out.filter((F.size("_removed") == 0) | F.col("_left").rlike(WORD)).select(*put_back(out, docs.columns, text, F.col("_left")))
