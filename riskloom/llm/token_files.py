"""Token files: a wavelet matrix per shard.

A shard holds the ids of consecutive documents. Its ids are stored as bit planes, highest bit first;
each plane is in the order that the planes above have sorted the ids into, zeros before ones. Planes
are cut into blocks of ``BLOCK`` bytes, each packed by zstd where that helps, with the number of ones
before every block. So one file answers, without unpacking the rest: which id stands at a place
(``access``), how often an id occurs before it (``rank``), and where its k-th occurrence is (``select``).

Layout of a file, little-endian: magic, numbers of documents, ids and planes, block size, number of null
document ids (they come first); document ids and their sizes; per plane the number of zeros, and per block its end and the ones before it; blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release
from .tokens import word_encoder
from .words import text_slices

MAGIC = b"WVMX2\0\0\0"
BLOCK = 4096
#: Ids handled at once when a plane is put back; their places stay in the processor's cache.
STEP = 1 << 16
END_ID = 1
SHARD_TOKENS = 2_000_000


def build_shard(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray, planes: int = 16, nulls: int = 0) -> bytes:
    """The file of one shard: ``ids`` of all its documents in a row, ``sizes`` ids each; the first ``nulls`` documents have no id."""
    pack = zstandard.ZstdCompressor(level=1).compress
    n = len(ids)
    head = [MAGIC, struct.pack("<QQIIQ", len(doc_ids), n, planes, BLOCK, nulls), doc_ids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes()]
    body: list[bytes] = []
    end = 0
    current = ids
    for plane in range(planes - 1, -1, -1):
        bits = (current & np.uint16(1 << plane)) != 0
        ones = np.compress(bits, current)  # several times faster than a mask as index
        packed = np.packbits(bits)
        raw = packed.tobytes()
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        ends, before = [], np.zeros(len(blocks), "<i8")
        if n:
            counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK), dtype=np.int64)
            before[1:] = np.cumsum(counts)[:-1]
        for b in blocks:
            small = pack(b)
            body.append(b"z" + small if len(small) < len(b) else b"r" + b)
            end += len(body[-1])
            ends.append(end)
        head += [struct.pack("<Q", n - len(ones)), np.array(ends, "<i8").tobytes(), before.tobytes()]
        current = np.concatenate([np.compress(~bits, current), ones])
    return b"".join(head + body)


class Shard:
    """Reads a shard file; ``data`` is its bytes or a memory map."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token shard")
        docs, self.n, self.planes, self.block, self.nulls = struct.unpack("<QQIIQ", view[8:40])
        at = 40

        def longs(count: int) -> np.ndarray:
            nonlocal at
            at += 8 * count
            return np.frombuffer(view[at - 8 * count : at], "<i8")

        self.doc_ids, self.sizes = longs(docs), longs(docs)
        blocks = -(-self.n // (8 * self.block))
        self.zeros, self._ends, self._before = [], [], []
        for _ in range(self.planes):
            self.zeros.append(int(longs(1)[0]))
            self._ends.append(longs(blocks))
            self._before.append(longs(blocks))
        self._body = view[at:]
        self._unpack = zstandard.ZstdDecompressor().decompress
        self._bits = lru_cache(maxsize=64)(self._read)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def _raw(self, plane: int, block: int) -> bytes:
        ends = self._ends[plane]
        before = ends[block - 1] if block else (self._ends[plane - 1][-1] if plane else 0)
        piece = self._body[int(before) : int(ends[block])]
        return self._unpack(piece[1:], max_output_size=self.block) if piece[0] == ord("z") else bytes(piece[1:])

    def _read(self, plane: int, block: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self._raw(plane, block), np.uint8))

    def _ones(self, plane: int, i: int) -> int:
        """Ones of the plane before place ``i``."""
        block, within = divmod(i, 8 * self.block)
        if block == len(self._before[plane]):
            return self.n - self.zeros[plane]
        return int(self._before[plane][block]) + int(self._bits(plane, block)[:within].sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            bit = int(self._bits(p, i // (8 * self.block))[i % (8 * self.block)])
            ones = self._ones(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the ids equal to ``value`` among the first ``i`` lie below the last plane."""
        low, high = 0, i
        for p in range(self.planes):
            a, b = self._ones(p, low), self._ones(p, high)
            if value >> (self.planes - 1 - p) & 1:
                low, high = self.zeros[p] + a, self.zeros[p] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before place ``i``."""
        low, high = self._range(value, min(i, self.n))
        return high - low

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        return self.rank(value, self.n if end is None else end) - self.rank(value, start)

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence of ``value``, from 0; -1 if there are fewer."""
        low, high = self._range(value, self.n)
        if k < 0 or k >= high - low:
            return -1
        i = low + k
        for p in range(self.planes - 1, -1, -1):
            bit = value >> (self.planes - 1 - p) & 1
            i = self._find(p, bit, i - self.zeros[p] if bit else i)
        return i

    def _find(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th ``bit`` of a plane."""
        places = np.arange(len(self._before[plane])) * 8 * self.block
        before = self._before[plane] if bit else places - self._before[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        left = min(8 * self.block, self.n - int(places[block]))
        hits = np.flatnonzero(self._bits(plane, block)[:left] == bit)
        return int(places[block]) + int(hits[k - int(before[block])])

    def ids(self) -> np.ndarray:
        """All ids in order, rebuilt from the lowest plane up."""
        out = np.zeros(self.n, np.uint16)
        for p in range(self.planes - 1, -1, -1):
            raw = b"".join(self._raw(p, b) for b in range(len(self._ends[p])))
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)
            one = np.uint16(1 << (self.planes - 1 - p))
            upper = np.empty_like(out)
            zero, high = 0, self.zeros[p]
            for at in range(0, self.n, STEP):
                here, part = bits[at : at + STEP], upper[at : at + STEP]
                low, up = np.flatnonzero(~here), np.flatnonzero(here)
                part[low] = out[zero : zero + len(low)]
                part[up] = out[high : high + len(up)] | one
                zero, high = zero + len(low), high + len(up)
            out = upper
        return out


_SHARDS = "part int, seq int, n_docs long, n_tokens long, file binary"


def _write(path: str, shard_tokens: int, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        part, seq = TaskContext.get().partitionId(), 0
        ids, docs, sizes, nulls = [], [], [], 0

        def shard() -> pa.RecordBatch:
            flat, sz = np.concatenate(ids), np.concatenate(sizes)
            file = build_shard(flat, np.concatenate(docs), sz, nulls=nulls)
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "n_docs": [len(sz)], "n_tokens": [len(flat)], "file": [file]}, schema=schema
            )

        for batch in batches:
            doc_ids, unnamed = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            texts = batch.column(1)
            for i, j in text_slices(texts):
                flat, first = encode(texts.slice(i, j - i))
                ids.append(np.insert(flat, first[1:], np.uint16(end_id)))
                docs.append(doc_ids[i:j])
                sizes.append(np.diff(first) + 1)
                nulls += int(unnamed[i:j].sum())
                if sum(map(len, ids)) >= shard_tokens:
                    yield shard()
                    seq += 1
                    ids, docs, sizes, nulls = [], [], [], 0
        if ids:
            yield shard()

    return run


def write_token_files(docs: DataFrame, path: str, text: str = "text", shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Encode all texts and write them to shards in ascending order of doc_id; the table of the files.

    ``part`` and ``seq`` number the shards in that order. Null ids come first, null texts count as
    empty (they have the end id alone), rows with the same id are ordered by text. An empty table gives no shard.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = materialize(ordered.mapInArrow(_write(path, shard_tokens, end_id), _SHARDS), "token-shards")
    release(docs.sparkSession)
    return files


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            shard = Shard(file.as_buffer())
            ids = shard.ids().astype("<u4")
            starts = shard.starts
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            n = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.full(n, seq, np.int32)),
                    pa.array(shard.doc_ids, mask=np.arange(n) < shard.nulls),
                    pa.array(starts[:-1]),
                    pa.array(shard.sizes),
                    pa.array(crcs, pa.int64()),
                ],
                names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document as read from the files: doc_id, start, n_tokens, ids_crc32."""
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0)).alias("in_part"))
    # one row per range partition, so the running total over all of them is small
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    starts = shards.join(parts, "part").select("part", "seq", (F.col("before") + F.col("in_part")).alias("shard_start"))
    rows = files.select("part", "seq", "file").mapInArrow(
        _read, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
