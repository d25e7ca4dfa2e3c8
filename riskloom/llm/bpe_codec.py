"""BPE encoding and decoding with a minimal acyclic transducer.

The words (pre-tokens) of the whole corpus are counted, the most frequent ones are encoded once, and the
word list with its ids becomes a minimal acyclic transducer: a deterministic automaton over bytes in
which equal suffixes share their states. Every state knows how many words end below it, so adding up the
numbers passed on the way gives each word its rank in the sorted list, and with it the place of its
ids. The automaton is a few flat arrays that workers map into memory. Words it does not hold are
merged exactly, pair by pair in the order of the merge ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import mmap
import os
import struct
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import byte_vocabulary, cut_pieces
from .words import text_slices

#: Words in the lexicon: a bound on its size (a few MB), not on what is counted or encoded.
LEXICON_WORDS = 150_000
_MAGIC = b"MATX1\0\0\0"


def build_automaton(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words.

    Returns ``first`` (first edge of each state, one entry more than states), ``edges`` (rows of
    byte, target, words that come before through this edge) and ``final``. State 0 is the root.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (is final, ((byte, state), ...))

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    last = b""
    for word in words:
        if word <= last and path[0] != [False, []]:
            raise ValueError("words must be sorted and distinct")
        common = len(os.path.commonprefix([word, last]))
        while len(path) > common + 1:  # what differs from the last word is finished below here
            done = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = settle(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = settle(path[0])

    number = {s: i for i, s in enumerate([root, *(s for s in range(len(states)) if s != root)])}
    below = [0] * len(states)  # words that end in or below a state; targets are settled before
    for s, (is_final, out) in enumerate(states):
        below[s] = is_final + sum(below[t] for _, t in out)
    first, edges, final = [0], [], np.zeros(len(states), bool)
    for s in sorted(range(len(states)), key=number.__getitem__):
        is_final, out = states[s]
        final[number[s]] = is_final
        before = int(is_final)
        for byte, t in out:
            edges.append((byte, number[t], before))
            before += below[t]
        first.append(len(edges))
    return np.array(first, np.int32), np.array(edges, np.int32).reshape(-1, 3), final


def pack_lexicon(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """The transducer as one flat file: the automaton and the ids of its words in sorted order."""
    order = sorted(range(len(words)), key=lambda i: words[i])
    first, edges, final = build_automaton([words[i] for i in order])
    sizes = [len(ids[i]) for i in order]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.array([t for i in order for t in ids[i]], np.int32)
    parts = [first, edges.ravel(), final.astype(np.int32), starts, flat]
    return _MAGIC + struct.pack("<5q", *map(len, parts)) + b"".join(p.astype("<i4").tobytes() for p in parts)


class Lexicon:
    """Reads a packed transducer; looks up many words at once, one byte of all of them per step."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:8]) != _MAGIC:
            raise ValueError("not a lexicon")
        at, parts = 48, []
        for n in struct.unpack("<5q", view[8:48]):
            parts.append(np.frombuffer(view[at : at + 4 * n], "<i4"))
            at += 4 * n
        self.first, edges, self.final, self.starts, self.flat = parts
        self.edges = edges.reshape(-1, 3)
        # edges sorted by (state, byte), so one binary search finds an edge
        states = np.repeat(np.arange(len(self.final)), np.diff(self.first))
        self._keys = states.astype(np.int64) * 256 + self.edges[:, 0]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rank of each word ``data[start:end]`` in the sorted list, or -1."""
        state = np.zeros(len(start), np.int64)
        rank = np.zeros(len(start), np.int64)
        out = np.full(len(start), -1, np.int64)
        live = np.arange(len(start))
        at = start.copy()
        while len(live):
            ended = at[live] == end[live]
            over = live[ended]
            hit = over[self.final[state[over]] > 0]
            out[hit] = rank[hit]
            live = live[~ended]
            if not len(live) or not len(self._keys):
                break
            key = state[live] * 256 + data[at[live]]
            edge = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            ok = self._keys[edge] == key
            live, edge = live[ok], edge[ok]
            state[live] = self.edges[edge, 1]
            rank[live] += self.edges[edge, 2]
            at[live] += 1
        return out


class Merger:
    """Exact BPE of one word: join the adjacent pair of the lowest rank until none is left."""

    NONE = 1 << 60

    def __init__(self, path: str):
        self.bytes_of, self.added, merges = byte_vocabulary(path)
        special = set(self.added.values())
        ids = {b: i for i, b in enumerate(self.bytes_of) if i not in special}
        self._rank: dict[int, int] = {}  # of a pair of ids, as one number
        for rank, (a, b) in enumerate(merges):
            self._rank.setdefault(ids[a] << 32 | ids[b], rank)
        self._made = [ids[a + b] for a, b in merges]
        self._byte = [ids[bytes([b])] for b in range(256)]
        pairs = sorted(self._rank.items())
        self._keys = np.array([k for k, _ in pairs], np.int64)
        self._ranks = np.array([r for _, r in pairs], np.int64)
        self._made_array = np.array(self._made, np.int64)

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._ranks[at], self.NONE)

    def many(self, words: list[bytes], widest: int = 32) -> list[list[int]]:
        """The ids of many words. Words of similar lengths are rows of a matrix, in which every step joins the
        first pair of the lowest rank of each row."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (8, 16, widest):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                for i, ids in zip(part.tolist(), self._matrix([words[i] for i in part.tolist()], sizes[part], width)):
                    out[i] = ids
            low = width
        for i in np.flatnonzero(sizes > widest).tolist():
            out[i] = self(words[i])
        return out

    def _matrix(self, words: list[bytes], sizes: np.ndarray, width: int) -> Iterator[list[int]]:
        n, columns = len(words), np.arange(width)
        parts = np.full((n, width + 1), -1, np.int64)
        parts[:, :width][columns < sizes[:, None]] = np.array(self._byte, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self._ranks_of(parts[:, :-1], parts[:, 1:])
        done = np.full((n, width + 1), -1, np.int64)
        row = np.arange(n)
        while len(row):
            i = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), i]
            over = least == self.NONE
            if over.any():
                done[row[over]] = parts[over]
                row, parts, ranks, i, least = row[~over], parts[~over], ranks[~over], i[~over], least[~over]
                if not len(row):
                    break
            each = np.arange(len(row))
            parts[each, i] = self._made_array[least]
            parts[:, :width] = np.take_along_axis(parts, columns + (columns > i[:, None]), axis=1)
            parts[:, width] = -1
            shifted = np.minimum(columns + (columns >= i[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, shifted, axis=1)
            ranks[:, width - 1] = self.NONE
            ranks[each, i] = self._ranks_of(parts[each, i], parts[each, i + 1])
            left = np.flatnonzero(i > 0)
            j = i[left] - 1
            ranks[left, j] = self._ranks_of(parts[left, j], parts[left, j + 1])
        counts = (done >= 0).sum(axis=1)
        flat, ends = done[done >= 0].tolist(), np.cumsum(counts).tolist()
        for a, b in zip([0, *ends[:-1]], ends):
            yield flat[a:b]

    def __call__(self, word: bytes) -> list[int]:
        parts = [self._byte[b] for b in word]
        if len(parts) > 64:
            return self._long(parts)
        rank, made, none = self._rank.get, self._made, self.NONE
        ranks = [rank(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], none)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list, for very long words."""
        n, rank = len(parts), self._rank.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = self._made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank(parts[x] << 32 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]


class Codec:
    """Encodes batches of texts with a lexicon and decodes ids."""

    #: Pieces beyond the lexicon that a worker remembers; then the older half goes. Results do not depend on it.
    MEMORY = 300_000

    def __init__(self, path: str, lexicon):
        self.merge = Merger(path)
        self.lexicon = Lexicon(lexicon)
        self._pattern = regex.compile(public_tokenizers.PATTERN)
        marks = self.merge.added
        self._marks = regex.compile("(" + "|".join(regex.escape(m) for m in marks) + ")") if marks else None
        self._lead = os.path.commonprefix(list(marks)) if marks else ""
        self._unseen: dict[str, list[int]] = {}
        sizes = np.array([len(b) for b in self.merge.bytes_of], np.int64)
        self._byte_starts = np.concatenate([[0], np.cumsum(sizes)])
        self._byte_sizes = sizes
        self._bytes = np.frombuffer(b"".join(self.merge.bytes_of), np.uint8)

    def words(self, piece: str) -> list[str]:
        """Pre-tokens of a piece; added tokens stand alone."""
        if self._marks is None or self._lead not in piece:
            return self._pattern.findall(piece)
        return [w for part in self._marks.split(piece) for w in ([part] if part in self.merge.added else self._pattern.findall(part))]

    def _merged(self, pieces: list[str]) -> list[list[int]]:
        """The ids of pieces that are not in the lexicon."""
        if len(self._unseen) > self.MEMORY:
            self._unseen = dict(islice(self._unseen.items(), len(self._unseen) - self.MEMORY // 2, None))
        known, added = self._unseen, self.merge.added
        cut = {p: self.words(p) for p in pieces if p not in known}
        words = list({w for ws in cut.values() for w in ws})
        ids = dict(zip(words, self.merge.many([w.encode() for w in words])))
        ids |= {mark: [i] for mark, i in added.items()}
        for p, ws in cut.items():
            known[p] = ids[ws[0]] if len(ws) == 1 else [t for w in ws for t in ids[w]]
        return [known[p] for p in pieces]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the first id of each text."""
        pieces, codes, first = cut_pieces(texts)
        # whole pieces that the lexicon holds are words; only the others are cut by the pattern
        listed = pieces.cast(pa.large_binary())
        offsets = np.frombuffer(listed.buffers()[1], np.int64)[: len(listed) + 1] if len(listed) else np.zeros(1, np.int64)
        raw = np.frombuffer(listed.buffers()[2], np.uint8) if len(listed) and listed.buffers()[2] is not None else np.zeros(0, np.uint8)
        rank = self.lexicon.find(raw, offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64))
        rest = np.flatnonzero(rank < 0)
        ids = self._merged(pieces.take(pa.array(rest)).to_pylist())
        # the ids of all distinct pieces in one array: those of the lexicon, then those just merged
        begins = np.empty(len(rank), np.int64)
        sizes = np.empty(len(rank), np.int64)
        known = rank >= 0
        begins[known] = self.lexicon.starts[rank[known]]
        sizes[known] = self.lexicon.starts[rank[known] + 1] - begins[known]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        sizes[rest] = n
        begins[rest] = len(self.lexicon.flat) + np.concatenate([[0], np.cumsum(n)])[:-1]
        flat = np.concatenate([self.lexicon.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))])
        total = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(total)])
        # the places of 32 bits suffice for one batch
        shift = np.repeat((begins[codes] - ends[:-1]).astype(np.int32), total)
        shift += np.arange(ends[-1], dtype=np.int32)
        return flat[shift], ends[first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
        """The text of each run of ids as UTF-8; what is not valid becomes U+FFFD."""
        sizes = self._byte_sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.repeat((self._byte_starts[ids] - ends[:-1]).astype(np.int32), sizes)
        shift += np.arange(ends[-1], dtype=np.int32)
        raw = self._bytes[shift].tobytes()
        at = ends[first].tolist()
        for a, b in zip(at[:-1], at[1:]):
            yield raw[a:b].decode("utf-8", errors="replace").encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pattern = regex.compile(public_tokenizers.PATTERN)
    for batch in batches:
        texts = batch.column(0)
        for i, j in text_slices(texts):
            pieces, codes, _ = cut_pieces(texts.slice(i, j - i))
            counts = np.bincount(codes, minlength=len(pieces))
            words: dict[str, int] = {}
            for p, n in zip(pieces.to_pylist(), counts.tolist()):
                for w in pattern.findall(p):
                    words[w] = words.get(w, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each word occurs in the whole corpus; summed in the tasks before the shuffle."""
    source = docs.select(F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The words above the lowest count that no more than ``most`` words reach, so words of equal counts are
    in or out together. Only one row per distinct count is ranked."""
    per_count = counts.groupBy("n").agg(F.count("*").alias("words"))
    upto = Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    least = per_count.withColumn("_upto", F.sum("words").over(upto)).filter(F.col("_upto") <= most).agg(F.min("n")).first()[0]
    return counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)


def fit_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS, text: str = "text") -> bytes:
    """The packed transducer of the most frequent words, at most ``words`` of them."""
    counts = materialize(word_counts(docs, text), "word-counts")
    top = frequent_words(counts, words).select("word").collect()
    merge = Merger(path)
    listed = sorted(r.word.encode() for r in top if r.word not in merge.added)
    return pack_lexicon(listed, [merge(w) for w in listed])


_CODECS: dict[str, Codec] = {}


def _codec(path: str, lexicon: bytes) -> Codec:
    """The worker's codec. The lexicon lies in anonymous memory that is mapped; no disk of the machine is used."""
    key = hashlib.sha256(lexicon).hexdigest()
    if key not in _CODECS:
        fd = os.memfd_create("lexicon")
        with os.fdopen(fd, "wb") as f:
            f.write(lexicon)
            f.flush()
            view = mmap.mmap(fd, len(lexicon), prot=mmap.PROT_READ)
        _CODECS.clear()
        _CODECS[key] = Codec(path, view)
    return _CODECS[key]


_OUTPUTS = {
    "n_tokens": ("long", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
}


_MAKE = {
    "n_tokens": lambda ids, text: len(ids),
    "ids_sha256": lambda ids, text: hashlib.sha256(ids).hexdigest(),
    "decoded_sha256": lambda ids, text: hashlib.sha256(text).hexdigest(),
    "ids": lambda ids, text: ids,
    "decoded": lambda ids, text: text.decode(),
}


def _transcode(path: str, lexicon, outputs: Sequence[str]):
    schema = pa.schema([("doc_id", pa.int64()), *[(o, _OUTPUTS[o][1]) for o in outputs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, lexicon.value)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for i, j in text_slices(texts):
                ids, first = codec.encode(texts.slice(i, j - i))
                cols: dict[str, list] = {o: [] for o in outputs}
                raw = ids.astype("<u4")
                decoded = codec.decode(ids, first) if {"decoded", "decoded_sha256"} & set(outputs) else iter([b""] * (j - i))
                for a, b, text in zip(first[:-1].tolist(), first[1:].tolist(), decoded):
                    for o in outputs:
                        cols[o].append(_MAKE[o](raw[a:b], text))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(i, j - i), *[pa.array(cols[o], _OUTPUTS[o][1]) for o in outputs]], schema=schema
                )

    return run


def bpe_codec(
    docs: DataFrame,
    path: str,
    words: int = LEXICON_WORDS,
    text: str = "text",
    outputs: Sequence[str] = ("n_tokens", "ids_sha256", "decoded_sha256"),
) -> DataFrame:
    """Encode and decode every text with the byte-level BPE file at ``path``; one row per input row.

    ``outputs`` may also name ``ids`` and ``decoded``. Null texts count as empty and have no ids;
    null and repeated ids are passed on; an empty table gives no rows. Added tokens of the file are
    recognised inside texts. ``words`` bounds the lexicon; every word is counted, and words beyond
    the lexicon are merged, so ids do not depend on it.
    """
    lexicon = docs.sparkSession.sparkContext.broadcast(fit_lexicon(docs, path, words, text))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"{o} {_OUTPUTS[o][0]}" for o in outputs)
    return source.mapInArrow(_transcode(path, lexicon, outputs), f"doc_id long, {kinds}")
