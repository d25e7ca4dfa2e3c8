"""Ranked lexical search over a length-stratified index.

A document's length enters its score only through the normaliser m, so documents of equal m form a
stratum in which a term's impact depends on its frequency alone. The index keeps the postings of a
stratum by term and, within a term, by frequency: an impact is computed once for each frequency and
holds for all documents behind it. Large strata are stored in segments of about ``SEGMENT`` documents.

The largest frequency of each term in a stratum bounds what any of its documents can score for an
item. These bounds order the visits. Every item visits its most promising strata first, until they hold
``FIRST`` documents; its k-th best score there is a threshold that all others must reach. Then it visits the remaining
strata whose bound does, and none of the rest, which cannot hold a result. The ranking is exact.

Items are searched in batches of at most ``PAIRS`` (item, term) pairs, so what is broadcast, their terms
and weights, has that bound; postings are kept for the terms of the batch. Scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, release, row_numbers

SEGMENT = 1024
FIRST = 256
PAIRS = 1_000_000
#: Scale of impacts, saturation times frequency, and the shares of the normaliser that length does and doesn't move.
SCALE, STEP, NORM, SLOPE = 1_000_000_000, 1000, 8, 75

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same as bytes: what ends a term is a blank, A-Z are lower, all else stays.
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)

_COUNTS = "row long, doc_id long, n long, terms array<int>, tfs array<int>"
_INDEX = (
    "m long, ids array<long>, terms array<int>, term_ends array<int>, tfs array<int>, tf_ends array<int>, posts array<int>"
)
_HITS = "item int, doc_id long, score long"


def terms_of(text: Column) -> Column:
    """The terms of a text in order; null has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def impact(tf, m):
    """What one unit of weight is worth at frequency ``tf`` under normaliser ``m``."""
    return (SCALE * tf) // (STEP * tf + NORM * m)


def _lists(rows: list[np.ndarray], kind: pa.DataType = pa.int32()) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _count(vocabulary):
    """Term counts of every document that has a term: its number of terms, and those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value.get
        for first, batch in row_numbers(batches):
            rows, lengths, terms, tfs = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                words = text.as_buffer().to_pybytes().translate(_BYTES).split() if text.is_valid else []
                if not words:
                    continue
                counts = Counter(map(known, words))
                counts.pop(None, None)
                rows.append(i)
                lengths.append(len(words))
                terms.append(np.fromiter(counts.keys(), np.int32, len(counts)))
                tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
            if rows:
                ids = batch.column(0).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(rows) + first), ids, pa.array(lengths, pa.int64()), _lists(terms), _lists(tfs)],
                    names=["row", "doc_id", "n", "terms", "tfs"],
                )

    return run


def _segment(m: int, ids: list, terms: np.ndarray, tfs: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """One row of the index: postings by term, then by falling frequency, then by document."""
    order = np.lexsort((docs, -tfs, terms))
    terms, tfs, docs = terms[order], tfs[order], docs[order]
    new_term = np.flatnonzero(np.diff(terms, prepend=-1))
    new_tf = np.flatnonzero((np.diff(terms, prepend=-1) != 0) | (np.diff(tfs, prepend=0) != 0))
    tf_ends = np.append(new_tf[1:], len(docs))
    term_ends = np.append(np.searchsorted(new_tf, new_term[1:]), len(new_tf))
    columns = [terms[new_term], term_ends, tfs[new_tf], tf_ends, docs]
    return pa.RecordBatch.from_arrays(
        [pa.array([m], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *[_lists([c]) for c in columns]],
        names=["m", "ids", "terms", "term_ends", "tfs", "tf_ends", "posts"],
    )


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from documents sorted by segment and id."""
    key, ids, held = None, [], []

    def flush() -> pa.RecordBatch:
        docs = np.repeat(np.arange(len(ids)), [len(t) for t, _ in held])
        return _segment(key[0], ids, np.concatenate([t for t, _ in held]), np.concatenate([f for _, f in held]), docs)

    for batch in batches:
        ms, segments, doc_ids = (batch.column(i).to_pylist() for i in range(3))
        for i, new in enumerate(zip(ms, segments)):
            if new != key:
                if ids:
                    yield flush()
                key, ids, held = new, [], []
            ids.append(doc_ids[i])
            held.append(tuple(batch.column(k)[i].values.to_numpy() for k in (3, 4)))
    if ids:
        yield flush()


class Batch:
    """The (item, term) pairs of a batch, ordered by term, with weights times the term's count in the item."""

    def __init__(self, items: np.ndarray, terms: np.ndarray, weights: np.ndarray, vocabulary: int):
        order = np.argsort(terms, kind="stable")
        self.items, self.weights = items[order], weights[order]
        self.starts = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.size = int(items.max()) + 1 if len(items) else 0

    def pairs(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of these terms: the index into ``terms`` and the pair's own number."""
        counts = self.starts[terms + 1] - self.starts[terms]
        which = np.repeat(np.arange(len(terms)), counts)
        return which, _ranges(self.starts[terms], counts)

    def bounds(self, terms: np.ndarray, most: np.ndarray, m: int) -> np.ndarray:
        """Per item, what a document can score at most where ``most`` are the largest frequencies."""
        which, pair = self.pairs(terms)
        out = np.zeros(self.size, np.int64)
        np.add.at(out, self.items[pair], self.weights[pair] * impact(most.astype(np.int64), m)[which])
        return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range in turn."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _bound(shared):
    """Per stratum the items that can score there, with their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, docs, terms, most in zip(*(batch.column(i) for i in range(4))):
                m, docs = m.as_py(), docs.as_py()
                bounds = shared.value.bounds(terms.values.to_numpy(), most.values.to_numpy(), m)
                items = np.flatnonzero(bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.int32()), pa.array(bounds[items]), pa.array(np.full(len(items), m)), pa.array(np.full(len(items), docs))],
                    names=["item", "bound", "m", "docs"],
                )

    return run


class _Best:
    """The k best documents of every item seen so far, and the score that a further one must reach."""

    def __init__(self, k: int, size: int):
        self.k, self.cut = k, np.ones(size, np.int64)
        self.held: list[tuple] = []
        self.count = 0

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        self.held.append((items, scores, ids, known))
        self.count += len(items)
        if self.count > 500_000:
            self.compact()

    def compact(self) -> None:
        if not self.held:
            return
        columns = [np.concatenate(c) for c in zip(*self.held)]
        items, scores, ids, known = columns
        columns = [c[np.lexsort((ids, known, -scores, items))] for c in columns]  # null ids first
        place = np.arange(len(items)) - np.searchsorted(columns[0], columns[0])
        last = place == self.k - 1
        reached = columns[0][last]
        self.cut[reached] = np.maximum(self.cut[reached], columns[1][last])
        self.held = [tuple(c[place < self.k] for c in columns)]
        self.count = len(self.held[0][0])


def _score(shared, k: int, at_once: int = 512, most: int = 2_000_000):
    """The best documents of a task's segments for the items that visit them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Batch = shared.value
        best = _Best(k, queries.size)
        for batch in batches:
            for m, ids, terms, term_ends, tfs, tf_ends, posts, items, least in zip(*batch.columns):
                m = m.as_py()
                terms, term_ends, tfs, tf_ends, posts = (c.values.to_numpy() for c in (terms, term_ends, tfs, tf_ends, posts))
                items, least = items.values.to_numpy(), least.values.to_numpy()
                best.cut[items] = np.maximum(best.cut[items], least)
                # the segment has bounds of its own, often lower than the stratum's
                first_tf = np.concatenate([[0], term_ends[:-1]])
                bounds = queries.bounds(terms, tfs[first_tf], m)
                items = items[bounds[items] >= best.cut[items]]
                if not len(items):
                    continue
                known = np.array([i is not None for i in ids.as_py()])
                numbers = np.array([i or 0 for i in ids.as_py()], np.int64)
                sizes = np.diff(tf_ends, prepend=0)
                worth = np.repeat(impact(tfs.astype(np.int64), m), sizes)  # one impact per frequency
                ends = tf_ends[term_ends - 1]
                starts = np.concatenate([[0], ends[:-1]])
                which, pair = queries.pairs(terms)
                of = queries.items[pair]
                for at in range(0, len(items), at_once):
                    some = items[at : at + at_once]
                    slot = np.full(queries.size, -1)
                    slot[some] = np.arange(len(some))
                    mine = slot[of] >= 0
                    rows, weights, term = slot[of[mine]], queries.weights[pair[mine]], which[mine]
                    counts = (ends - starts)[term]
                    totals = np.zeros(len(some) * len(numbers), np.int64)
                    reach = np.cumsum(counts)
                    low = 0
                    while low < len(term):
                        high = max(low + 1, int(np.searchsorted(reach, (reach[low - 1] if low else 0) + most, "right")))
                        c = counts[low:high]
                        where = _ranges(starts[term[low:high]], c)
                        place = np.repeat(rows[low:high] * len(numbers), c) + posts[where]
                        np.add.at(totals, place, np.repeat(weights[low:high], c) * worth[where])
                        low = high
                    totals = totals.reshape(len(some), len(numbers))
                    r, d = np.nonzero(totals >= best.cut[some][:, None])
                    best.add(some[r], totals[r, d], numbers[d], known[d])
        best.compact()
        if best.held:
            items, scores, ids, known = best.held[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int32()), pa.array(ids, mask=~known), pa.array(scores)], names=["item", "doc_id", "score"]
            )

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def build_index(counts: DataFrame, documents: int, tokens: int, segment: int = SEGMENT) -> DataFrame:
    """The index of counted documents: one row per segment of a stratum."""
    m = F.expr(f"{100 - SLOPE}L + ({SLOPE}L * n * {documents}L) DIV {tokens}L")
    docs = counts.filter(F.size("terms") > 0).withColumn("m", m)
    strata = docs.groupBy("m").agg(F.ceil(F.count("*") / segment).alias("segments"))
    dealt = docs.join(strata, "m").withColumn("segment", F.pmod(F.xxhash64("row"), F.col("segments")))
    dealt = dealt.select("m", "segment", "doc_id", "terms", "tfs", "row").repartition("m", "segment")
    dealt = dealt.sortWithinPartitions("m", "segment", "doc_id", "row").drop("row")
    return materialize(dealt.mapInArrow(_invert, _INDEX), "search-index")


def _search(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame | None:
    """The best documents for the items of one batch; ``pairs`` has item, term and count."""
    spark = docs.sparkSession
    asked = pairs.collect()  # at most PAIRS
    words = {w: i for i, w in enumerate(sorted({r["term"] for r in asked}))}
    vocabulary = spark.sparkContext.broadcast({w.encode(): i for w, i in words.items()})
    counts = materialize(docs.mapInArrow(_count(vocabulary), _COUNTS), "search-counts")
    totals = counts.agg(F.count("*").alias("documents"), F.sum("n").alias("tokens")).first()
    if not totals["documents"]:
        return None
    # weights of the batch's terms
    n = totals["documents"]
    holding = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(words), np.int64)
    for r in holding.select("term", weight.alias("w")).collect():  # one row per term of the batch at most
        weights[r["term"]] = r["w"]
    terms = np.array([words[r["term"]] for r in asked], np.int64)
    held = np.array([r["held"] for r in asked], np.int64)
    shared = spark.sparkContext.broadcast(
        Batch(np.array([r["item"] for r in asked], np.int64), terms, held * weights[terms], len(words))
    )
    index = build_index(counts, n, totals["tokens"])
    release(spark)

    # bounds: the largest frequency of each term in each stratum
    largest = F.transform(
        "terms",
        lambda t, i: F.struct(t.alias("term"), F.get("tfs", F.when(i == 0, 0).otherwise(F.get("term_ends", i - 1))).alias("tf")),
    )
    tops = index.select("m", F.explode(largest).alias("x"))
    most = tops.groupBy("m", F.col("x.term").alias("term")).agg(F.max("x.tf").alias("tf"))
    sizes = index.groupBy("m").agg(F.sum(F.size("ids")).cast("long").alias("docs"))
    strata = most.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("x")).join(sizes, "m")
    strata = strata.select("m", "docs", F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs"))
    visits = strata.mapInArrow(_bound(shared), "item int, bound long, m long, docs long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    before = F.coalesce(F.sum("docs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    visits = materialize(visits.withColumn("first", before < FIRST), "search-visits")

    def scored(chosen: DataFrame) -> DataFrame:
        by_stratum = chosen.groupBy("m").agg(F.collect_list(F.struct("item", "least")).alias("v"))
        by_stratum = by_stratum.select("m", F.col("v.item").alias("items"), F.col("v.least").alias("least"))
        return index.join(by_stratum, "m").mapInArrow(_score(shared, k), _HITS)

    one = F.lit(1).cast("long")
    found = materialize(_best(scored(visits.filter("first").withColumn("least", one)), k), "search-first")
    least = found.filter(F.col("rank") == k).select("item", F.col("score").alias("reached"))
    rest = visits.filter("NOT first").join(least, "item", "left").withColumn("least", F.coalesce("reached", one))
    later = scored(rest.filter(F.col("bound") >= F.col("least")))
    out = materialize(_best(found.drop("rank").unionByName(later), k), "search-found")
    vocabulary.unpersist()
    shared.unpersist()
    release(spark)
    return out


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "item int, doc_id long, score long, rank int")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, pairs: int = PAIRS) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank, doc_id, score.

    Reads doc_id and text of ``docs`` and item_id and text of ``items``; other columns are ignored. Every
    row is a document or an item of its own, also where ids or texts repeat; a document id that stands
    in several rows can take several ranks. Null and empty texts, and texts without a term, count no term:
    such documents count nowhere, such items get no rows. Equal scores go by ascending id, null ids
    first. Only documents with a score above 0 are returned. Texts are read whole, whatever their length.
    Empty tables give no rows. ``pairs`` bounds the (item, term) pairs that are searched at a time.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(
        F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), terms_of(F.col("text")).alias("terms")
    )
    asked = materialize(asked.withColumn("size", F.size(F.array_distinct("terms"))), "search-items")
    size = asked.agg(F.sum("size")).first()[0] or 0
    batches = max(1, math.ceil(size / pairs))
    asked = asked.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)))
    found = []
    for b in range(batches):
        own = asked.filter((F.col("batch") == b) & (F.col("size") > 0)).withColumn(
            "item", F.row_number().over(Window.orderBy("row")) - 1
        )
        own = materialize(own, "search-batch")  # numbered without gaps
        terms = own.select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count("*").alias("held"))
        best = _search(source, terms, k)
        if best is not None:
            found.append(best.join(own.select("item", "item_id"), "item"))
    if not found:
        return _empty(spark).select(F.lit(None).cast("long").alias("item_id"), "rank", "doc_id", "score")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
