"""Merkle manifest of a table by time-forward processing.

Every row is a leaf. Per source the leaves ascend by id, and runs of ``FAN`` nodes become one node
until a single one, the subroot, remains; the subroots of all sources form one more tree. Nodes are
labelled by when all they depend on is known: the position of the last leaf below them, then their
level. A node sends its digest to the label of its parent through a priority queue ordered by label,
so the digests of a run arrive together and in order, whenever they were computed.

The queue has two parts. Between blocks of ``FAN ** DEPTH`` nodes it is Spark's sorted shuffle, which
spills to disk: a block's nodes arrive in label order. Inside a block it is a heap of at most ``FAN``
messages a level. One round takes every tree ``DEPTH`` levels up, so the rounds grow with the logarithm
of the largest source. The reversed sweep goes back down through the same blocks with the order turned
round: a block gets the proof suffix of its root, hands it on to its children with their own siblings in
front, and so delivers to every leaf the siblings up to the root.

The text is read once, in the step that computes the leaves, and never moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

FAN = 16
#: Levels that one task climbs in a block; a block holds ``FAN ** DEPTH`` nodes.
DEPTH = 2
BLOCK = FAN**DEPTH

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = "tree string, pos long, n long, digest binary"
_SUFFIX = "tree string, pos long, left array<string>, right array<string>, subroot binary"
_PROOF = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def _field(c: Column) -> Column:
    """A value as it enters a leaf: its length in bytes and itself, or a dash for null."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaves(docs: DataFrame, tamper_modulus: int = 5) -> DataFrame:
    """row, doc_id, tree (the source), leaf, and the leaf of the tampered row where the row is tampered with."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")

    def digest(body: Column) -> Column:
        parts = [doc_id, F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), body]
        return F.unhex(F.sha2(F.concat(*[_field(p) for p in parts]), 256))

    chosen = F.crc32(doc_id.cast("string").cast("binary")) % tamper_modulus == 0
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        doc_id.alias("doc_id"),
        F.col("source").cast("string").alias("tree"),
        digest(text).alias("leaf"),
        F.when(chosen, digest(F.translate(text, _UPPER, _LOWER))).alias("tampered"),
    )


def _placed(nodes: DataFrame, spread: list, order: list[str], name: str) -> DataFrame:
    """``nodes`` with their position in their tree and the tree's number of nodes.

    Rows are dealt to ranges of ``spread`` and sorted in them; a tree's place in a range is its first row
    there plus its rows in earlier ranges, so a tree of any size is numbered by all tasks together.
    """
    dealt = nodes.repartitionByRange(*spread).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition, then the row in it
    dealt = materialize(dealt.select("*", F.shiftright(at, 33).alias("range"), at.alias("at")), name)
    ranges = dealt.groupBy("tree", "range").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    # one row per tree and range it touches
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0))
    starts = ranges.select(
        F.col("tree").alias("t"),
        F.col("range").alias("r"),
        (before - F.col("first")).alias("shift"),
        F.sum("rows").over(whole).alias("n"),
    )
    joined = dealt.join(starts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("range") == F.col("r")))
    return joined.withColumn("pos", F.col("at") + F.col("shift")).drop("t", "r", "shift", "range", "at")


def _climb(n: int) -> int:
    """Levels that a round takes a tree of ``n`` nodes up."""
    return 0 if n == 1 else 1 if n <= FAN else DEPTH


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _label(index: int, level: int, n: int) -> tuple[int, int]:
    """When node ``index`` of ``level`` can be computed: after its last leaf (of a round's ``n``), by level."""
    return min((index + 1) * FAN**level, n) - 1, level


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The roots of the blocks whose nodes arrive in order."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def sweep() -> Iterator[tuple]:
        queue: list[tuple] = []
        for tree, n, pos, digest in _rows(batches):
            top = _climb(n)
            heappush(queue, (_label(pos // FAN, 1, n), pos, digest.hex()))
            while queue and queue[0][0][0] <= pos:
                label, parts = queue[0][0], []
                while queue and queue[0][0] == label:
                    parts.append(heappop(queue)[2])
                level, value = label[1], _h(*parts)
                index = pos // FAN**level
                if level == top:
                    yield tree, index, -(-n // FAN**top), bytes.fromhex(value)
                else:
                    heappush(queue, (_label(index // FAN, level + 1, n), index, value))

    return _batches(sweep(), schema)


def _risen(nodes: DataFrame, name: str) -> DataFrame:
    """The next round's nodes: one per block of the trees that have more than one node."""
    queue = nodes.filter("n > 1").select("tree", "n", "pos", "digest", F.expr(f"pos DIV {BLOCK}").alias("block"))
    queue = queue.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return materialize(queue.drop("block").mapInArrow(_forward, _NODE), name)


def _suffixes(nodes: list[tuple], n: int, left: list, right: list) -> Iterator[tuple[tuple, list, list]]:
    """A block's nodes, each with its siblings on the way up to the root of all.

    ``nodes`` are (position, digest, ...) in order, ``left`` and ``right`` the siblings of the block's root.
    The queue runs backwards here: parents, whose labels are later, come before their children.
    """
    top, first = _climb(n), nodes[0][0]
    levels = [[d.hex() for _, d, *_ in nodes]]
    for _ in range(top):
        below = levels[-1]
        levels.append([_h(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
    queue: list[tuple] = []

    def send(level: int, index: int, lefts: list, rights: list) -> None:
        last, lv = _label(index, level, n)
        heappush(queue, (-last, -lv, index, lefts, rights))

    send(top, first // FAN**top, left, right)
    while queue:
        _, level, index, lefts, rights = heappop(queue)
        level = -level
        if level == 0:
            yield nodes[index - first], lefts, rights
            continue
        low = first // FAN ** (level - 1)
        run = levels[level - 1][index * FAN - low : index * FAN - low + FAN]
        for k in range(len(run)):
            send(level - 1, index * FAN + k, ["".join(run[:k]), *lefts], ["".join(run[k + 1 :]), *rights])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Blocks of a sorted partition: (tree, n, nodes, left, right, subroot); the suffix is a block's first row."""
    key, nodes, head = None, [], None
    for tree, block, pos, n, digest, doc_id, tampered, left, right, subroot in _rows(batches):
        if (tree, block) != key or pos is None:
            if nodes:
                yield tree_of, n_of, nodes, *head
            key, nodes, head = (tree, block), [], (left, right, subroot)
            continue
        tree_of, n_of = tree, n
        nodes.append((pos, digest, doc_id, tampered))
    if nodes:
        yield tree_of, n_of, nodes, *head


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of all nodes of the blocks, to be sent on to the blocks below them."""
    strings = pa.list_(pa.string())
    schema = pa.schema(
        [("tree", pa.string()), ("pos", pa.int64()), ("left", strings), ("right", strings), ("subroot", pa.binary())]
    )

    def sweep() -> Iterator[tuple]:
        for tree, n, nodes, left, right, subroot in _blocks(batches):
            for node, lefts, rights in _suffixes(nodes, n, left, right):
                yield tree, node[0], lefts, rights, subroot

    return _batches(sweep(), schema, 500)


def _prove(root: str):
    s = pa.string()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("leaf", s), ("subroot", s), ("root", s), ("proof_sha256", s), ("folded_root", s),
         ("verified", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sweep() -> Iterator[tuple]:
            for _, n, nodes, left, right, subroot in _blocks(batches):
                for (_, leaf, doc_id, tampered), lefts, rights in _suffixes(nodes, n, left, right):
                    folded = (tampered or leaf).hex()
                    for before, after in zip(lefts, rights):
                        folded = _h(before, folded, after)
                    proof = _h(*[x for pair in zip(lefts, rights) for x in pair])
                    yield doc_id, leaf.hex(), subroot.hex(), root, proof, folded, folded == root

        return _batches(sweep(), schema)

    return run


def _queue(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes and the suffixes sent to their blocks, each block together, the suffix first."""
    block = F.expr(f"pos DIV {BLOCK}").alias("block")
    for c, kind in (("doc_id", "long"), ("tampered", "binary")):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast(kind))
    none = F.lit(None).cast("array<string>")
    sides = [none.alias("left"), none.alias("right"), F.lit(None).cast("binary").alias("subroot")]
    own = nodes.select("tree", block, "pos", "n", "digest", "doc_id", "tampered", *sides)
    empty = {"pos": "long", "n": "long", "digest": "binary", "doc_id": "long", "tampered": "binary"}
    sent = messages.select(
        "tree", F.col("pos").alias("block"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], "left", "right", "subroot"
    )
    return own.unionByName(sent).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The nodes of every round, from the leaves up to where each tree has one node."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(_risen(levels[-1], f"{name}-{len(levels)}"))
        most = -(-most // BLOCK)
    return levels


def _down(levels: list[DataFrame], ends: DataFrame, name: str) -> DataFrame:
    """Suffix messages for the blocks of the lowest round. ``ends`` has the suffix of every tree's root and
    the round ``level`` in which the tree has one node."""
    sent = ends.filter(F.col("level") == len(levels) - 1).drop("level")
    for k in range(len(levels) - 1, 0, -1):
        below = _queue(levels[k], sent).mapInArrow(_hand_down, _SUFFIX)
        sent = materialize(below, f"{name}-{k}").unionByName(ends.filter(F.col("level") == k - 1).drop("level"))
    return sent


def _roots(levels: list[DataFrame]) -> DataFrame:
    """The single node of every tree and the round it was reached in."""
    single = [x.filter("n = 1").select("tree", "digest", F.lit(k).alias("level")) for k, x in enumerate(levels)]
    out = single[0]
    for x in single[1:]:
        out = out.unionByName(x)
    return out


def merkle_manifest(docs: DataFrame, tamper_modulus: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Reads doc_id, source, lang, n_chars and text; other columns are ignored. Nulls enter a leaf as a dash,
    so a null text differs from an empty one; a null source is a source of its own, before all others; null
    ids come first in their source. Rows that share an id are ordered by their leaves; equal rows have
    equal leaves, and any order of them gives the same tree. Texts of any length enter whole. A source of
    one row has its leaf as subroot, a table of one source its subroot as root. An empty table gives no
    rows. ``tamper_modulus`` chooses the rows whose text is changed before they are checked.
    """
    spark = docs.sparkSession
    rows = materialize(leaves(docs, tamper_modulus), "merkle-leaves")
    rows = rows.withColumn("spread", F.xxhash64("tree"))
    spread = ["spread", "doc_id", "leaf", "row"]
    placed = _placed(rows, spread, ["spread", "tree", *spread[1:]], "merkle-sorted")
    nodes = materialize(
        placed.select("tree", "pos", "n", F.col("leaf").alias("digest"), "doc_id", "tampered"), "merkle-placed"
    )
    release(spark)
    levels = _rounds(nodes, "merkle-nodes")

    # the subroots, in the order of their sources, are the leaves of one more tree
    subroots = materialize(_roots(levels), "merkle-subroots")
    above = subroots.select(
        F.lit(None).cast("string").alias("tree"), F.col("tree").alias("source"), F.col("digest"), F.col("level")
    )
    prefix = F.substring(F.col("source").cast("binary"), 1, 64)
    tops = materialize(_placed(above, [prefix], ["source"], "merkle-sources"), "merkle-sources")
    top_levels = _rounds(tops.select("tree", "pos", "n", "digest"), "merkle-tops")
    found = _roots(top_levels).first()
    root = bytes(found["digest"]).hex() if found else ""
    nothing = F.array().cast("array<string>")
    start = _roots(top_levels).select(
        "tree", F.lit(0).cast("long").alias("pos"), nothing.alias("left"), nothing.alias("right"), F.col("digest").alias("subroot"), "level"
    )
    sent = _down(top_levels, start, "merkle-top-suffixes")
    of_source = materialize(_queue(top_levels[0], sent).mapInArrow(_hand_down, _SUFFIX), "merkle-source-suffixes")
    ends = tops.join(of_source.select("pos", "left", "right"), "pos").select(
        F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "left", "right", F.col("digest").alias("subroot"), "level"
    )
    ends = materialize(ends, "merkle-ends")
    release(spark)

    sent = _down(levels, ends, "merkle-suffixes")
    return _queue(levels[0], sent).mapInArrow(_prove(root), _PROOF)
