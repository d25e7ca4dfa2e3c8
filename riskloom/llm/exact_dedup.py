"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed size. Blocks are dealt by their hash, sorted, and equal ones get
the same integer name, numbered in that order within each part. Then adjacent names of a text are paired, equal pairs get one name, and so on
until every text has a single name. Names come from comparing contents, never from hashes, so two
texts have the same name only if they are equal.

Before anything is shuffled, equal texts of one Arrow batch become one local text with a list of
members. A group of copies therefore reaches the shuffles once per batch, however many rows it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, row_numbers

BLOCK = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_CUT = "row long, doc_id long, local long, pos int, block binary, size int, sha string"


def _cut(block: int):
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()), ("pos", pa.int32()), ("block", pa.binary()),
         ("size", pa.int32()), ("sha", pa.string())]
    )

    def rows(first: int, batch: pa.RecordBatch) -> Iterator[tuple]:
        seen: dict[bytes, tuple[int, str]] = {}
        for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
            raw = text.as_buffer().to_pybytes().translate(_LOWER) if text.is_valid else b""
            known = seen.get(raw)
            if known is None:
                known = seen[raw] = (first + i, hashlib.sha256(raw).hexdigest())
                for pos in range(max(1, -(-len(raw) // block))):
                    yield None, None, known[0], pos, raw[pos * block : (pos + 1) * block], max(1, -(-len(raw) // block)), None
            yield first + i, doc_id, known[0], None, None, None, known[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, batch in row_numbers(batches):
            held, size = [], 0
            for row in rows(first, batch):
                held.append(row)
                size += len(row[4] or b"") + 150
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return run


def _name_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the distinct blocks of a sorted part; parts number apart from each other."""
    name, last = (TaskContext.get().partitionId() << 40), None
    for batch in batches:
        names = []
        for block in batch.column(1):
            raw = block.as_buffer()
            if last is None or not raw.equals(last):
                name, last = name + 1, pa.py_buffer(raw.to_pybytes())
            names.append(name)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64())], names=["use", "name"])


def exact_dedup(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest
    doc_id stays; if rows repeat that doc_id, one of them stays. Null texts count as empty, and empty
    texts are equal to each other. Null ids rank lowest; a group of null ids has a null ``keep_id``
    and keeps one row. Other columns are not read; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    cut = materialize(source.mapInArrow(_cut(block), _CUT), "naming-blocks")
    members = cut.filter("row IS NOT NULL").select("row", "doc_id", "local", "sha")
    blocks = cut.filter("row IS NULL").select("local", "pos", "block", "size")

    # equal blocks meet by hash, so no block is sampled to the driver; each part is sorted and named by itself
    place = F.struct("local", "pos", "size").alias("use")
    named = (
        blocks.select(place, "block").repartition("block").sortWithinPartitions("block").mapInArrow(
            _name_sorted, "use struct<local:long,pos:int,size:int>, name long"
        ).select("use.local", "use.pos", "use.size", "name")
    )
    named = materialize(named, "naming-names")
    release(docs.sparkSession)

    done = named.filter("size = 1").select("local", F.lit(0).alias("level"), "name")
    longer = named.filter("size > 1")
    level, most = 0, longer.agg(F.max("size")).first()[0] or 1
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        half = F.floor(F.col("pos") / 2).cast("int")
        sides = longer.groupBy("local", half.alias("pos"), F.ceil(F.col("size") / 2).cast("int").alias("size")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0).cast("long")).alias("b"),
        )
        sides = materialize(sides, "naming-pairs")
        # distinct pairs, sorted and numbered within the parts in which they have met
        pairs = sides.select("a", "b").distinct().sortWithinPartitions("a", "b")
        names = materialize(pairs.withColumn("name", F.monotonically_increasing_id() + 1), "naming-names")
        named = sides.join(names, ["a", "b"]).select("local", "pos", "size", "name")
        named = materialize(named, "naming-names")
        done = done.unionByName(named.filter("size = 1").select("local", F.lit(level).alias("level"), "name"))
        longer = named.filter("size > 1")

    # texts of different numbers of levels differ, as do their sizes
    totals = members.groupBy("local").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("keep"))
    groups = done.join(totals, "local").groupBy("level", "name").agg(F.sum("n").alias("n"), F.max("keep").alias("keep"))
    of_local = done.join(groups, ["level", "name"]).select("local", "n", "keep")
    return members.join(of_local, "local").select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
