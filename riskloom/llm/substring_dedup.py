"""Substring dedup with fixed-block anchors.

A repeat counts from ``window`` words on. The reference index holds the hashes of every document's
non-overlapping blocks of half a window; any window covers one whole block of its document, whatever
the alignment. Every rolling window of a block's length probes that index, and what is found both as a
block and in another document is an anchor. Around each anchor the repeat is extended both ways, window
by window: a window of full length is looked up with its smallest document, and the windows that also
start in a smaller document join into maximal exact repeats, which are removed.

Hashes travel in batches of documents: sorted, without repeats, as differences of four bytes. A block that
is in very many documents therefore takes one entry per batch, and no pair of documents is ever formed.
Anchors are found with 48 bits, which may give a few idle ones; windows are compared with 96 bits.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import materialize, parts_for, release, text_bytes
from .words import Words, find_words, text_buffers, window_hashes, within

WINDOW = 50
BATCH_BYTES = 4 << 20
BUCKET_ENTRIES = 1_500_000
TASK_BYTES = 16 << 20
_LAST = (1 << 63) - 1  # null ids rank last, beside the largest id
_STEP = (1 << 30) - 1
_REF, _MANY = np.uint32(1 << 31), np.uint32(1 << 30)


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """Range of a 48-bit value among ``buckets`` equal ranges."""
    return ((values >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)


def _floor(bucket: int, buckets: int) -> int:
    return -(-(bucket << 32) // buckets) << 16


def pack(values: np.ndarray, floor: int, flags: np.ndarray | None = None) -> bytes:
    """Sorted values as differences of 30 bits; larger ones take steps without an entry. The two upper bits are flags."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(floor))
    steps = (gaps // np.uint64(_STEP)).astype(np.int64)
    codes = np.full(len(values) + int(steps.sum()), _STEP, np.uint32)
    places = np.arange(len(values)) + np.cumsum(steps)
    own = (gaps % np.uint64(_STEP)).astype(np.uint32)
    codes[places] = own if flags is None else own | flags
    return codes.tobytes()


def unpack(codes: bytes, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The values and their flags."""
    raw = np.frombuffer(codes, np.uint32)
    gaps = raw & np.uint32(_STEP)
    values = np.cumsum(gaps.astype(np.uint64)) + np.uint64(floor)
    entry = gaps != _STEP
    return values[entry], raw[entry] & (_REF | _MANY)


def _words(table: pa.Table | pa.RecordBatch) -> tuple[Words, np.ndarray]:
    return find_words(*text_buffers(table["text"])), table["doc_id"].fill_null(_LAST).to_numpy()


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by the keys (the first one leads), and where each group of equal keys starts."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    fresh = np.zeros(len(order), bool)
    if len(order):
        fresh[0] = True
        for k in keys:
            s = k[order]
            fresh[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(fresh)


_CODES = "batch long, bucket int, codes binary"


def _blocks_and_probes(block: int, buckets: int):
    """The rolling windows of a batch as index entries, marked where they are blocks or in several documents."""

    def run(table: pa.Table) -> pa.Table:
        batch = table["batch"][0].as_py()
        words, ids = _words(table)
        places = within(words.first, block)
        out = []
        if len(places):
            doc = np.searchsorted(words.first, places, side="right") - 1
            values = window_hashes(words.hashes, block)[places] >> np.uint64(16)
            is_block = (places - words.first[doc]) % block == 0
            order, starts = _groups(values)
            own = ids[doc][order]
            flags = np.where(np.logical_or.reduceat(is_block[order], starts), _REF, np.uint32(0))
            several = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
            flags |= np.where(several, _MANY, np.uint32(0))
            distinct = values[order][starts]
            edges = np.searchsorted(bucket_of(distinct, buckets), np.arange(buckets + 1))
            for b in range(buckets):
                i, j = edges[b], edges[b + 1]
                if j > i:
                    out.append((batch, b, pack(distinct[i:j], _floor(b, buckets), flags[i:j])))
        return _table(out, ("batch", pa.int64()), ("bucket", pa.int32()), ("codes", pa.binary()))

    return run


def _table(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(fields, columns)})


def _anchors(buckets: int):
    """Values of a bucket that are a block somewhere and occur in more than one document, per batch that has them."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        floor = _floor(bucket, buckets)
        batches = table["batch"].to_pylist()
        parts = [unpack(c.as_buffer(), floor) for chunk in table["codes"].chunks for c in chunk]
        values, flags = (np.concatenate(x) for x in zip(*parts))
        order, starts = _groups(values)
        seen = np.bitwise_or.reduceat(flags[order], starts)
        sizes = np.diff(np.append(starts, len(order)))
        shared = (seen & _REF > 0) & ((sizes > 1) | (seen & _MANY > 0))
        hit = np.zeros(len(order), bool)
        hit[order] = np.repeat(shared, sizes)
        # entries lie part after part
        edges = np.cumsum([0, *(len(v) for v, _ in parts)])
        out = [(b, values[i:j][hit[i:j]]) for b, i, j in zip(batches, edges[:-1], edges[1:])]
        rows = [(b, bucket, pack(v, floor)) for b, v in out if len(v)]
        return _table(rows, ("batch", pa.int64()), ("bucket", pa.int32()), ("codes", pa.binary()))

    return run


_DOC_FIELDS = (("batch", pa.int64()), ("doc_id", pa.int64()), ("n_rows", pa.int64()), ("n_words", pa.int64()), ("text", pa.string()), ("hits", pa.binary()), ("sha", pa.string()))
_DOC = "batch long, doc_id long, n_rows long, n_words long, text string, hits binary, sha string"


def _mark(block: int, window: int, buckets: int):
    """Documents with anchors keep text and anchor places; all others are finished."""

    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], *_DOC_FIELDS)
        words, _ = _words(docs)
        hit = np.zeros(len(words.hashes), bool)
        if anchors.num_rows:
            parts = sorted(zip(anchors["bucket"].to_pylist(), anchors["codes"].to_pylist()))
            known = np.concatenate([unpack(c, _floor(b, buckets))[0] for b, c in parts])
            places = within(words.first, block)
            values = window_hashes(words.hashes, block)[places] >> np.uint64(16)
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            hit[places] = known[at] == values
        before = np.concatenate([[0], np.cumsum(hit)])
        some = (before[words.first[1:]] > before[words.first[:-1]]) & (words.counts >= window)
        rows, batch = [], docs["batch"][0].as_py()
        for i, (doc_id, n, text) in enumerate(zip(*(docs[c].to_pylist() for c in ("doc_id", "n_rows", "text")))):
            a, b = words.first[i], words.first[i + 1]
            if some[i]:
                rows.append((batch, doc_id, n, int(b - a), text, np.packbits(hit[a:b]).tobytes(), None))
            else:
                rows.append((batch, doc_id, n, int(b - a), None, None, hashlib.sha256(b" ".join(text.encode().split())).hexdigest()))
        return _table(rows, *_DOC_FIELDS)

    return run


def _candidates(docs: pa.Table, block: int, window: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and ids of the documents, and the full windows that hold an anchor: place, 64 and 32 bits of hash."""
    words, ids = _words(docs)
    hit = np.concatenate(
        [np.unpackbits(np.frombuffer(h, np.uint8), count=n) for h, n in zip(docs["hits"].to_pylist(), words.counts.tolist())]
    )
    before = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    places = within(words.first, window)
    places = places[before[places + (window - block) + 1] > before[places]]
    high = window_hashes(words.hashes, window)[places] if len(places) else np.zeros(0, np.uint64)
    low = (window_hashes(words.hashes, window, seed=9)[places] >> np.uint64(32)).astype(np.uint32) if len(places) else np.zeros(0, np.uint32)
    return words, ids, places, high, low


_WINDOWS = "batch long, bucket int, high binary, low binary, least binary"
_WINDOW_FIELDS = (("batch", pa.int64()), ("bucket", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("least", pa.binary()))


def _extend(block: int, window: int, buckets: int):
    """The distinct windows around the anchors of a batch, each with its smallest document there."""

    def run(docs: pa.Table) -> pa.Table:
        batch = docs["batch"][0].as_py()
        words, ids, places, high, low = _candidates(docs, block, window)
        out = []
        if len(places):
            doc = np.searchsorted(words.first, places, side="right") - 1
            order, starts = _groups(high, low)
            least = np.minimum.reduceat(ids[doc][order], starts)
            high, low = high[order][starts], low[order][starts]
            edges = np.searchsorted(bucket_of(high >> np.uint64(16), buckets), np.arange(buckets + 1))
            for b in range(buckets):
                i, j = edges[b], edges[b + 1]
                if j > i:
                    out.append((batch, b, high[i:j].tobytes(), low[i:j].tobytes(), least[i:j].tobytes()))
        return _table(out, *_WINDOW_FIELDS)

    return run


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = (("high", np.uint64), ("low", np.uint32), ("least", np.int64))
    return tuple(np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in kinds)


def _smallest(table: pa.Table) -> pa.Table:
    """The windows of a bucket that a batch shares with a smaller document of another batch, with that document."""
    bucket, batches = table["bucket"][0].as_py(), table["batch"].to_pylist()
    high, low, least = _arrays(table)
    sizes = [len(x) // 8 for x in table["high"].to_pylist()]
    order, starts = _groups(high, low)
    smallest = np.empty(len(order), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(least[order], starts), np.diff(np.append(starts, len(order))))
    news = smallest < least
    out, at = [], 0
    for batch, n in zip(batches, sizes):
        own = slice(at, at + n)
        pick = news[own]
        if pick.any():
            out.append((batch, bucket, high[own][pick].tobytes(), low[own][pick].tobytes(), smallest[own][pick].tobytes()))
        at += n
    return _table(out, *_WINDOW_FIELDS)


_RESULT = "doc_id long, n_rows long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,end:int>>, text string"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _remove(block: int, window: int, with_text: bool):
    """Joins the windows that start in a smaller document into maximal repeats and takes their words out."""

    def run(docs: pa.Table, smaller: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            words, ids, places, high, low = _candidates(docs, block, window)
            doc = np.searchsorted(words.first, places, side="right") - 1
            # the batch's own windows and those heard of, grouped alike
            h, lo, least = _arrays(smaller) if smaller.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
            order, starts = _groups(np.concatenate([high, h]), np.concatenate([low, lo]))
            every = np.concatenate([ids[doc], least])
            smallest = np.empty(len(order), np.int64)
            if len(order):
                smallest[order] = np.repeat(np.minimum.reduceat(every[order], starts), np.diff(np.append(starts, len(order))))
            repeated = places[smallest[: len(places)] < ids[doc]]
            change = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(change, repeated, 1)
            np.add.at(change, repeated + window, -1)
            covered = np.cumsum(change)[:-1] > 0
            for i, (doc_id, n, n_words, text) in enumerate(zip(*(docs[c].to_pylist() for c in ("doc_id", "n_rows", "n_words", "text")))):
                gone = covered[words.first[i] : words.first[i + 1]]
                kept = b" ".join(compress(text.encode().split(), (~gone).tolist()))
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]
                rows.append((doc_id, n, n_words, int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode() if with_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS, pa.string())
        return _table(rows, *zip(("doc_id", "n_rows", "n_words", "n_removed", "kept_sha256", "repeats", "text"), kinds))

    return run


def substring_dedup(
    docs: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    with_text: bool = False,
    batch_bytes: int = BATCH_BYTES,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, repeats (word spans), text.

    Removed is every word covered by ``window`` consecutive words whose sequence also starts in a document with a
    smaller doc_id; windows are judged on the input. Null texts have no words. Null ids rank last, beside the largest id of 64 bits, and
    are not smaller than each other; rows that repeat an id do not remove each other's words, and repeats inside one document stay. Rows that
    repeat id and text are one document with a count until the end. Texts are read whole, whatever their length. ``text``
    (kept words joined by single blanks) is given for changed documents if ``with_text``. An empty table gives no rows; other columns are not read.

    A task reads about ``task_bytes`` of text, however large the table is.
    """
    if window < 4 or window % 2:
        raise ValueError("window must be even and at least 4")
    spark, block = docs.sparkSession, window // 2
    size = text_bytes(docs, text)
    batches = max(1, math.ceil(size / batch_bytes))
    buckets = parts_for(docs, size / 6, BUCKET_ENTRIES)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(size / task_bytes))

    def dealt(rows: DataFrame, key: str) -> GroupedData:
        return rows.repartition(tasks, key).groupBy(key)

    body = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body)
    source = source.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch"))
    # the counting takes place where the batches lie, without a further exchange
    source = source.repartition(tasks, "batch").groupBy("batch", "doc_id", "text").agg(F.count("*").alias("n_rows"))

    probes = source.groupBy("batch").applyInArrow(_blocks_and_probes(block, buckets), _CODES)
    anchors = materialize(dealt(probes, "bucket").applyInArrow(_anchors(buckets), _CODES), "anchors")
    release(spark)
    marked = source.groupBy("batch").cogroup(dealt(anchors, "batch")).applyInArrow(_mark(block, window, buckets), _DOC)
    marked = materialize(marked, "anchored")
    release(spark)
    touched = marked.filter("sha IS NULL").repartition(tasks, "batch")
    windows = touched.groupBy("batch").applyInArrow(_extend(block, window, buckets), _WINDOWS)
    smaller = materialize(dealt(windows, "bucket").applyInArrow(_smallest, _WINDOWS), "repeats")
    release(spark)
    changed = touched.groupBy("batch").cogroup(dealt(smaller, "batch")).applyInArrow(_remove(block, window, with_text), _RESULT)
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = marked.filter("sha IS NOT NULL").select(
        "doc_id", "n_rows", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), none.alias("repeats"), F.lit(None).cast("string").alias("text")
    )
    rows = whole.unionByName(changed).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256", "repeats", "text")
