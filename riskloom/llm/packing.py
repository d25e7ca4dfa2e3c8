"""Packing documents into sequences by a grouping genetic algorithm on islands.

Pieces are dealt at random into cells of bounded size. Every cell lives on several islands: Spark
groups that each evolve a small population of packings with seeds of their own. A child takes whole
well-filled bins from one parent, drops the bins of the other parent that share a document with them,
and best-fits the displaced documents. After an epoch each island's best packing also migrates to the
next island, the islands evolve again, and the best packing of a cell is taken. Documents in loosely
filled bins then meet those of other cells in another round with fewer cells.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import byte_encoder
from .words import text_slices

CAPACITY = 2048
END_ID = 0
CELL = 2_000
ISLANDS = 2
POPULATION = 4
GENERATIONS = 4
LOOSE = 0.97


class Packing:
    """Bins of one cell: the bin of every item, and what each bin holds."""

    def __init__(self, sizes: np.ndarray, capacity: int, bins: np.ndarray | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = np.full(len(sizes), -1, np.int64) if bins is None else bins
        placed = self.bins >= 0
        n = int(self.bins.max()) + 1 if placed.any() else 0
        self.fill = np.bincount(self.bins[placed], weights=sizes[placed], minlength=n).astype(np.int64)

    def best_fit(self, order: np.ndarray) -> Packing:
        """Place the items in the given order, each where the least room is left; else in a new bin."""
        room: dict[int, list[int]] = {}
        open_rooms = 0  # bit r: some bin has r left
        for b, f in enumerate(self.fill.tolist()):
            if 0 < f < self.capacity:
                r = self.capacity - f
                room.setdefault(r, []).append(b)
                open_rooms |= 1 << r
        fill = self.fill.tolist()
        for i in order.tolist():
            size = int(self.sizes[i])
            fits = open_rooms >> size
            if fits:
                r = size + (fits & -fits).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    open_rooms &= ~(1 << r)
            else:
                r, b = self.capacity, len(fill)
                fill.append(0)
            fill[b] += size
            self.bins[i] = b
            if r > size:
                room.setdefault(r - size, []).append(b)
                open_rooms |= 1 << (r - size)
        self.fill = np.array(fill, np.int64)
        return self

    @property
    def fitness(self) -> tuple[int, float]:
        """Fewer bins are better, then fuller ones."""
        used = self.fill[self.fill > 0]
        return -len(used), float(((used / self.capacity) ** 2).sum())

    def compact(self) -> Packing:
        _, bins = np.unique(self.bins, return_inverse=True)
        return Packing(self.sizes, self.capacity, bins)


def _by_size(sizes: np.ndarray, items: np.ndarray) -> np.ndarray:
    return items[np.argsort(-sizes[items], kind="stable")]


def crossover(a: Packing, b: Packing, rng: np.random.Generator) -> Packing:
    """Inject well-filled bins of ``b`` into ``a`` and best-fit what that displaces."""
    full = np.flatnonzero(b.fill >= b.capacity * 0.995)
    if not len(full):
        full = np.argsort(-b.fill)[: max(1, len(b.fill) // 10)]
    taken = rng.choice(full, max(1, len(full) // 2), replace=False)
    injected = np.isin(b.bins, taken)
    broken = np.unique(a.bins[injected])
    # the loosest bins are given up too, so that their documents find better places
    loose = np.argsort(a.fill)[: max(1, len(a.fill) // 20)]
    displaced = (np.isin(a.bins, broken) | np.isin(a.bins, loose)) & ~injected
    bins = a.bins.copy()
    bins[displaced] = -1
    bins[injected] = b.bins[injected] + len(a.fill)
    child = Packing(a.sizes, a.capacity, bins)
    return child.best_fit(_by_size(a.sizes, np.flatnonzero(displaced))).compact()


def evolve(sizes: np.ndarray, capacity: int, seed: int, start: list[Packing], population: int, generations: int) -> Packing:
    """The best packing after some generations from the given ones, filled up with best-fit packings
    of items in slightly shuffled order of size."""
    rng = np.random.default_rng(seed)
    people = list(start)
    everything = np.arange(len(sizes))
    while len(people) < population:
        noise = rng.uniform(0.9, 1.1, len(sizes)) if people else 1.0
        order = everything[np.argsort(-(sizes * noise), kind="stable")]
        people.append(Packing(sizes, capacity).best_fit(order))
    least = -(-int(sizes.sum()) // capacity)
    for _ in range(generations):
        people.sort(key=lambda p: p.fitness, reverse=True)
        if -people[0].fitness[0] <= least:
            break
        parents = people[: max(2, population // 2)]
        children = []
        for _ in range(population - len(parents) + 1):
            i, j = rng.choice(len(parents), 2, replace=False) if len(parents) > 1 else (0, 0)
            children.append(crossover(parents[i], parents[j], rng))
        people = sorted([*people, *children], key=lambda p: p.fitness, reverse=True)[:population]
    return max(people, key=lambda p: p.fitness)


_ITEM = "cell long, island int, uid long, length int, bin long"


def _island(capacity: int, population: int, generations: int, epoch: int, round_: int):
    """One epoch of one island: rows are its items, with the bins of its own and of the migrant packing."""

    def run(rows: pa.Table) -> pa.Table:
        cell, island = rows.column("cell")[0].as_py(), rows.column("island")[0].as_py()
        rows = rows.sort_by([("guest", "ascending"), ("uid", "ascending")])
        own = rows.filter(pc.equal(rows["guest"], 0))
        sizes = own["length"].to_numpy().astype(np.int64)
        start = []
        if own["bin"].null_count == 0:
            guests = rows["guest"].to_numpy()
            start = [Packing(sizes, capacity, rows["bin"].to_numpy()[guests == g]) for g in np.unique(guests)]
        seed = [round_, epoch, island, cell & 0x7FFFFFFF]
        best = evolve(sizes, capacity, seed, start, population, generations)
        n = len(sizes)
        return pa.table(
            {
                "cell": pa.array(np.full(n, cell, np.int64)),
                "island": pa.array(np.full(n, island, np.int32)),
                "uid": own["uid"],
                "length": own["length"],
                "bin": pa.array(best.bins),
            }
        )

    return run


def pack_items(
    items: DataFrame,
    capacity: int = CAPACITY,
    cell: int = CELL,
    islands: int = ISLANDS,
    population: int = POPULATION,
    generations: int = GENERATIONS,
) -> DataFrame:
    """Pack items (uid, length), each at most ``capacity`` long: uid and sequence_id.

    A sequence is named by the smallest uid in it. Items that fill a sequence alone are not dealt.
    Rounds end when one cell holds all that is loose, or when a round saves too little.
    """
    done = items.filter(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"))
    rest = items.filter(F.col("length") < capacity).select("uid", "length")
    round_, before = 0, None
    while True:
        n = rest.count()
        if not n:
            return done
        cells = -(-n // cell)
        dealt = rest.select(
            F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(cells)).alias("cell"), "uid", F.col("length").cast("int").alias("length")
        )
        people = dealt.select(
            "cell",
            F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
            "uid",
            "length",
            F.lit(None).cast("long").alias("bin"),
            F.lit(0).alias("guest"),
        )
        for epoch in range(2 if islands > 1 else 1):
            if epoch:  # every best packing also goes to the next island
                visits = F.array(
                    F.struct(F.col("island").alias("island"), F.lit(0).alias("guest")),
                    F.struct(F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.lit(1).alias("guest")),
                )
                people = best.withColumn("visit", F.explode(visits)).select(
                    "cell", F.col("visit.island").alias("island"), "uid", "length", "bin", F.col("visit.guest").alias("guest")
                )
            best = people.groupBy("cell", "island").applyInArrow(_island(capacity, population, generations, epoch, round_), _ITEM)
            best = materialize(best, "packing-islands")
        fills = best.groupBy("cell", "island", "bin").agg(F.sum("length").alias("fill"), F.min("uid").alias("sequence_id"))
        scores = fills.groupBy("cell", "island").agg(F.count("*").alias("bins"), F.sum(F.col("fill") * F.col("fill")).alias("squares"))
        winner = scores.groupBy("cell").agg(F.min_by("island", F.struct("bins", -F.col("squares"), "island")).alias("island"))
        fills = fills.join(winner, ["cell", "island"])
        packed = materialize(best.join(fills, ["cell", "island", "bin"]).select("uid", "length", "sequence_id", "fill"), "packing-round")
        loose = F.col("fill") < F.lit(capacity * LOOSE)
        total = packed.filter(F.col("uid") == F.col("sequence_id")).agg(F.count("*"), F.count_if(loose)).first()
        saved = None if before is None else before - total[0]
        if cells == 1 or total[1] <= 1 or (saved is not None and saved <= before // 1000):
            return done.unionByName(packed.select("uid", "sequence_id"))
        done = done.unionByName(packed.filter(~loose).select("uid", "sequence_id"))
        rest = packed.filter(loose).select("uid", "length")
        round_, before = round_ + 1, total[1]


def _pieces(path: str, capacity: int, end_id: int):
    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for i, j in text_slices(texts):
                flat, first = encode(texts.slice(i, j - i))
                ids = np.insert(flat, first[1:], np.uint16(end_id)).astype("<u4")
                first = first + np.arange(len(first))
                n = np.diff(first)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - capacity * (pieces - 1)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                at = (first[:-1][doc] + start).tolist()
                crcs = [zlib.crc32(ids[a : a + k]) for a, k in zip(at, length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid + np.arange(len(doc))),
                        doc_ids.slice(i, j - i).take(pa.array(doc)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=names,
                )
                uid += len(doc)

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document: uid, doc_id, piece, start, length, ids_crc32.

    Each document's ids end with ``end_id``. Only longer documents are cut, into full pieces; the first
    piece takes what is over.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = source.mapInArrow(
        _pieces(path, capacity, end_id), "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    return materialize(rows, "packing-pieces")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", **settings: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and hold the end id alone; null and repeated ids are packed like
    others; an empty table gives no rows. Extra columns are not read.
    """
    pieces = token_pieces(docs, path, capacity, text=text)
    placed = pieces.join(pack_items(pieces.select("uid", "length"), capacity, **settings), "uid")
    order = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "uid").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", offset.alias("offset"))
