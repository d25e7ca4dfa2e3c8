"""Near duplicates by b-bit MinHash.

Every document's set of word shingles gets ``K`` minima. Bands of ``ROWS`` minima name the buckets in
which candidates meet; of each minimum only ``BITS`` mixed bits are kept, packed as bit planes. Counting
equal positions and correcting for chance collisions estimates the similarity of a candidate pair, and pairs
far below the limit are dropped. The others are confirmed on their full sets.

Copies (equal sets) are one node. Candidates of a bucket are not all paired: first every node meets the
bucket's smallest node, which joins groups of near copies; then, in buckets that still hold several
groups, the nodes outside the largest group meet all others, a block against a block. Pairs that pass the
estimate are tested inside the block, on their sets of half hashes, and only links that join groups of the block are
written, fewer than it has nodes. This is repeated until no link joins anything. Two linked texts share a bucket with
probability 1 - (1 - s**5)**40, which is 0.99998 at a similarity s of 0.75 and rises from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, put_back, release, row_numbers, set_aside
from .words import find_words, mix, text_buffers, text_slices, window_hashes, within

WIDTH = 5
ROWS, BANDS = 5, 40
K = ROWS * BANDS
BITS = 2
_LONGS = -(-K // 64)
#: Estimates have a standard deviation below 0.04, so pairs this far below the limit are no links.
MARGIN = 0.18
#: Sets below this size are compared whatever their estimate says.
FEW = 30
BLOCK = 512

_rng = np.random.default_rng(7)
_MULTIPLY = (_rng.integers(0, 2**31, K) * 2 + 1).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, K).astype(np.uint32)
_BAND = (_rng.integers(0, 2**62, ROWS, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within the text, and where each text's begin.

    Texts with fewer than ``width`` words have their whole sequence as the one shingle; texts without words have none.
    """
    w = find_words(*text_buffers(texts), lower=True)
    n = w.counts
    places = within(w.first, width)
    full = window_hashes(w.hashes, width)[places] if len(places) else np.zeros(0, np.uint64)
    sizes = np.maximum(n - width + 1, 0)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    short: dict[int, np.uint64] = {}
    for k in range(1, width):
        docs = np.flatnonzero(n == k)
        if len(docs):
            h = window_hashes(w.hashes, k, seed=100 + k)
            short.update(zip(docs.tolist(), h[w.first[docs]]))
    out, ends = [], np.zeros(len(n) + 1, np.int64)
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        if b > a:
            own = np.sort(full[a:b])
            if b - a > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif i in short:
            own = np.array([short[i]], np.uint64)
        else:
            own = full[:0]
        out.append(own)
        ends[i + 1] = len(own)
    return (np.concatenate(out) if out else full), np.cumsum(ends)


def signatures(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (``BITS`` planes of ``_LONGS`` longs) and band keys of each non-empty set."""
    sizes = np.diff(first)
    starts = first[:-1][sizes > 0]
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((len(starts), K), np.uint32)
    for k in range(K):
        minima[:, k] = np.minimum.reduceat(x * _MULTIPLY[k] + _ADD[k], starts)
    # an odd multiple keeps in its low bits which values agree there, at every position alike; mixed bits agree by chance
    mixed = (minima ^ (minima >> np.uint32(16))) * np.uint32(0x7FEB352D)
    mixed ^= mixed >> np.uint32(15)
    planes = []
    for b in range(BITS):
        bits = np.zeros((len(starts), _LONGS * 64), np.uint8)
        bits[:, :K] = (mixed >> np.uint32(b)) & np.uint32(1)
        planes.append(np.packbits(bits, axis=1).view(np.int64))
    rows = minima.reshape(len(starts), BANDS, ROWS).astype(np.uint64)
    keys = mix((rows * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.hstack(planes), keys.view(np.int64)


_SKETCH = "row long, doc_id long, th long, n int, id1 long, id2 long, sig array<long>, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def lists(values: np.ndarray, some: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(some * values.shape[1])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))

    for at, batch in row_numbers(batches):
        texts = batch.column(2)
        for i, j in text_slices(texts):
            hashes, first = shingles(texts.slice(i, j - i))
            n = np.diff(first)
            some = n > 0
            ids = np.zeros((2, j - i), np.uint64)
            if some.any():
                sig, bands = signatures(hashes, first)
                for k, salt in enumerate((0, 0xD1B54A32D192ED03)):
                    ids[k, some] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), first[:-1][some])
            else:
                sig, bands = np.zeros((0, BITS * _LONGS), np.int64), np.zeros((0, BANDS), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(at + i, at + j)),
                    batch.column(0).slice(i, j - i),
                    batch.column(1).slice(i, j - i),
                    pa.array(n.astype(np.int32)),
                    pa.array(ids[0].view(np.int64)),
                    pa.array(ids[1].view(np.int64)),
                    lists(sig, some),
                    lists(bands, some),
                ],
                names=["row", "doc_id", "th", "n", "id1", "id2", "sig", "bands"],
            )


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: equal positions, corrected for chance collisions."""
    differ = F.lit(0)
    for w in range(_LONGS):
        apart = F.lit(0).cast("long")
        for p in range(BITS):
            x = F.get(a, F.lit(p * _LONGS + w)).bitwiseXOR(F.get(b, F.lit(p * _LONGS + w)))
            apart = apart.bitwiseOR(x)
        differ = differ + F.bit_count(apart)
    chance = 2.0**-BITS
    return (1 - differ / K - chance) / (1 - chance)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            nodes, texts = batch.column(0), batch.column(1)
            for i, j in text_slices(texts):
                hashes, first = shingles(texts.slice(i, j - i), width)
                own = nodes.slice(i, j - i)
                values = own.to_pylist()
                keep = [v != u for u, v in zip([last, *values[:-1]], values)]
                last = values[-1]
                offsets = pa.array(first.astype(np.int32))
                sets = pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))
                # the sets are sorted, so their upper halves are as well
                folded = pa.ListArray.from_arrays(offsets, pa.array((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                out = pa.RecordBatch.from_arrays([own, sets, folded], names=["node", "set", "folded"])
                yield out.filter(pa.array(keep))

    return run


def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of the edges (a, b): node, label.

    Labels pass along edges, and every node also takes the label that its label has, so long chains need
    few rounds. Each round is written to the shared folder.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "near-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels = materialize(labels, "near-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        pulled = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        pulled = materialize(pulled, "near-labels")
        jump = pulled.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = pulled.join(jump, "label").select("node", "before", F.least("label", "further").alias("label"))
        moved = materialize(moved, "near-labels")
        labels = moved.select("node", "label")
        if moved.filter("label != before").isEmpty():
            return labels


def _linked(a: np.ndarray, b: np.ndarray, limit: float) -> bool:
    """Whether two sorted sets of 32-bit hashes are as similar as linked sets are; hashes that collide can only add to it."""
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= limit * (len(a) + len(b) - both) - 1e-9


def _meet(limit: float, spanning: bool):
    """Links between a block of outside nodes and a block of the bucket, tested on their sets of 32-bit hashes.

    ``spanning`` gives only links that join groups of this block that no earlier one has joined, so a block writes fewer
    rows than it has nodes; else all links between groups, each in the first bucket that both nodes share.
    """

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        side = rows["outside"].to_numpy(zero_copy_only=False).astype(bool)
        node, comp, n = (rows[c].to_numpy() for c in ("node", "comp", "n"))
        sig = rows["sig"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS, _LONGS)
        bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        folded = rows["folded"].combine_chunks()
        ends = folded.offsets.to_numpy() - folded.offsets[0].as_py()
        values = folded.flatten().to_numpy().view(np.uint32)
        earlier = bands[:, : int(np.flatnonzero(bands[0] == bucket)[0])]
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        group: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := group.get(c, c)) != c:
                group[c] = group.get(up, up)
                c = up
            return c

        found = []
        chance = 2.0**-BITS
        for i in left.tolist():
            apart = np.zeros((len(right), _LONGS), np.uint64)  # bits of signed numbers would be counted without sign
            for p in range(BITS):
                apart |= sig[right, p] ^ sig[i, p]
            differ = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
            similar = (1 - differ / K - chance) / (1 - chance)
            least, most = np.minimum(n[right], n[i]), np.maximum(n[right], n[i])
            # the estimate says little about sets of few shingles; these are cheap to compare
            may = ((similar >= limit - MARGIN) | (least < FEW)) & (comp[right] != comp[i]) & (least >= limit * most)
            own = values[ends[i] : ends[i + 1]]
            for j in right[may][np.argsort(-similar[may], kind="stable")].tolist():
                if spanning:
                    a, b = root(int(comp[i])), root(int(comp[j]))
                    if a != b and _linked(own, values[ends[j] : ends[j + 1]], limit):
                        group[a] = b
                        found.append((node[i], node[j]))
                elif not (earlier[i] == earlier[j]).any() and _linked(own, values[ends[j] : ends[j + 1]], limit):
                    found.append((node[i], node[j]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs.min(axis=1) if len(pairs) else pairs[:, 0]), "b": pa.array(pairs.max(axis=1) if len(pairs) else pairs[:, 1])})

    return run


def _outside_links(buckets: DataFrame, labels: DataFrame, small: DataFrame, limit: float, spanning: bool) -> DataFrame:
    """Links among the buckets that still hold several groups: the nodes outside a bucket's largest group
    against all its nodes, a block against a block."""
    in_group = buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("comp"))
    open_ = in_group.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("bucket")
    mixed = materialize(in_group.join(open_, "bucket"), "near-open")
    groups = mixed.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    largest = groups.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"))
    mixed = mixed.join(largest, "bucket").join(small, "node")
    outer, inner = F.ceil((F.col("all") - F.col("most")) / BLOCK), F.ceil(F.col("all") / (8 * BLOCK))
    spot, zero = F.xxhash64("node"), F.lit(0).cast("long")
    columns = ["node", "comp", "n", "sig", "bands", "folded"]
    outside = mixed.filter("comp != main").select(
        "bucket", F.pmod(spot, outer).alias("o"), F.explode(F.sequence(zero, inner - 1)).alias("i"), F.lit(True).alias("outside"), *columns
    )
    others = mixed.select(
        "bucket", F.explode(F.sequence(zero, outer - 1)).alias("o"), F.pmod(spot, inner).alias("i"), F.lit(False).alias("outside"), *columns
    )
    return outside.unionByName(others).groupBy("bucket", "o", "i").applyInArrow(_meet(limit, spanning), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, text: str = "text") -> DataFrame:
    """One row per input row: doc_id, th (hash of the text), n_shingles, component_id, kept.

    Documents are linked if ``100 * intersection >= percent * union`` of their shingle sets (words in
    any case of A-Z). ``component_id`` is the smallest doc_id of the linked group, and one row that has
    it stays. Texts without words, null ones included, are linked with nothing and stay. Null ids rank last in a
    group; a group of null ids has a null ``component_id`` and keeps one row. Rows that repeat an id are linked by
    their texts like others. Extra columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    limit = percent / 100
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"))
    sketch = materialize(source.mapInArrow(_sketch, _SKETCH), "near-sketches")

    # equal sets are one node, named by the smallest row
    of_set = sketch.filter("n > 0").groupBy("id1", "id2").agg(F.min("row").alias("node"))
    of_set = materialize(of_set, "near-nodes")
    nodes = sketch.join(of_set.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")

    # buckets with several nodes
    keys = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
    shared = shared.filter("pivot != last").select("bucket", "pivot")
    buckets = materialize(keys.join(shared, "bucket"), "near-buckets")
    release(spark)

    involved = buckets.select("node").distinct()
    known = materialize(nodes.join(involved, "node", "left_semi").select("node", "doc_id", "th", "n", "sig", "bands"), "near-candidates")
    found = source.join(
        known.select("node", F.col("doc_id").alias("_id"), F.col("th").alias("_th")),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")),
    ).select("node", "text")
    sets = materialize(found.sortWithinPartitions("node").mapInArrow(_sets(WIDTH), "node long, set array<long>, folded array<int>"), "near-sets")
    release(spark)
    small = known.select("node", "n", "sig", "bands").join(sets.select("node", "folded"), "node")

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
        two = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        links = pairs.join(one, "a").join(two, "b").withColumn("both", both)
        links = links.filter(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both")))
        return materialize(links.select("a", "b"), "near-links")

    # each node meets the smallest node of its buckets; the likeliest one is confirmed
    stars = buckets.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    one = known.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("siga"))
    two = known.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sigb"))
    stars = (
        stars.join(one, "a")
        .join(two, "b")
        .filter(F.least("na", "nb") >= limit * F.greatest("na", "nb"))
        .select("a", "b", estimate(F.col("siga"), F.col("sigb")).alias("similar"))
        .filter(F.col("similar") >= limit - MARGIN)
    )
    links = confirmed(stars.groupBy("a").agg(F.max_by("b", F.struct("similar", "b")).alias("b")))
    labels = components(links)

    # then who is outside a bucket's largest group meets the others, for as long as that joins groups; what then
    # still looks like a link between groups, because 32-bit hashes collide, is confirmed or refuted pair by pair
    while True:
        release(spark)
        more = confirmed(_outside_links(buckets, labels, small, limit, spanning=True))
        if more.isEmpty():
            break
        links = materialize(links.unionByName(more), "near-links")
        labels = components(links)
    more = confirmed(_outside_links(buckets, labels, small, limit, spanning=False))
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    # back to all rows
    named = of_set.join(labels, "node", "left").select("id1", "id2", F.coalesce("label", "node").alias("comp"))
    rows = sketch.select("row", "doc_id", "th", "n", "id1", "id2")
    rows = materialize(rows.filter("n > 0").join(named, ["id1", "id2"]).select("row", "doc_id", "th", "n", "comp"), "near-rows")
    first = rows.groupBy("comp").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("keep"), F.min("doc_id").alias("least"))
    linked = rows.join(first, "comp").select(
        "doc_id", "th", F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"), (F.col("row") == F.col("keep")).alias("kept")
    )
    alone = sketch.filter("n = 0").select("doc_id", "th", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, percent: int = 75, text: str = "text") -> DataFrame:
    """One document of each group of near duplicates, columns as in the input.

    Rows that repeat both id and text are one document: one of them stays.
    """
    kept = near_duplicates(docs, percent, text).filter("kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    aside = set_aside(docs, text, _doc=F.col("doc_id").cast("long"), _hash=F.xxhash64(body))
    joined = aside.join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")))
    return joined.dropDuplicates(["_doc", "_hash"]).select(*put_back(aside, docs.columns, text))
