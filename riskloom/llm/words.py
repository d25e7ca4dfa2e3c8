"""Words, word hashes and window hashes of whole Arrow text columns, computed in numpy.

A word is a maximal run of characters other than the space and the control characters 9 to 13. All
of these are single bytes in UTF-8, so words are found in the raw bytes of a column without
decoding it. Hashes are 64-bit: a polynomial over random byte values whose prefix sums give the hash
of any stretch at once, followed by a mixing step. Work memory is bounded by ``SEGMENT`` bytes of
text (or one longer word); what is returned takes a few bytes per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word (one-to-one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _family(seed: int) -> tuple[np.ndarray, int, int]:
    """Random byte values and an odd multiplier with its inverse modulo 2**64."""
    rng = np.random.default_rng(seed)
    table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1, 2**61)) * 8 + 5
    return table, base, pow(base, -1, 2**64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; short tables are kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if size <= SEGMENT:
            _POWERS[base] = have
    return have[:n]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; nulls become empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch of texts: byte ranges, hashes, and the first word of every text."""

    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # one entry more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _segments(white: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < n:
        to = min(n, at + SEGMENT)
        while to < n and not white[to]:  # up to the next white space
            ahead = np.flatnonzero(white[to : to + SEGMENT])
            to = to + int(ahead[0]) if len(ahead) else min(n, to + SEGMENT)
        yield at, to
        at = to


def find_words(data: np.ndarray, offsets: np.ndarray, seed: int = 1, lower: bool = False) -> Words:
    """All words of the texts; ``lower`` hashes A-Z like a-z."""
    table, base, inverse = _family(seed)
    if lower:
        table = table[_LOWER]
    n = len(data)
    starts, ends, hashes = [], [], []
    white = _WHITE[data]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    for at, to in _segments(white, n):
        word = ~white[at:to]
        begins = word.copy()
        begins[1:] &= white[at : to - 1]
        closes = word.copy()
        closes[:-1] &= white[at + 1 : to]
        own = cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, to)] - at
        begins[own] = word[own]
        before = own[own > 0] - 1
        closes[before] = word[before]
        s, e = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        if not len(s):
            continue
        sums = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum(table[data[at:to]] * _powers(base, to - at), out=sums[1:])
        h = (sums[e] - sums[s]) * _powers(inverse, to - at)[s]
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(mix(h + (e - s).astype(np.uint64)))
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return Words(
        start,
        np.concatenate(ends) if ends else np.zeros(0, np.int64),
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        np.searchsorted(start, offsets),
    )


def window_hashes(hashes: np.ndarray, width: int, seed: int = 2) -> np.ndarray:
    """Hash of every ``width`` consecutive values, across text ends too; shorter input gives none."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    _, base, inverse = _family(seed)
    out = np.empty(n - width + 1, dtype=np.uint64)
    step = SEGMENT
    for at in range(0, len(out), step):
        part = hashes[at : min(n, at + step + width - 1)]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * _powers(base, len(part)), out=sums[1:])
        m = len(part) - width + 1
        out[at : at + m] = (sums[width:] - sums[:m]) * _powers(inverse, m)
    return mix(out)


def within(first: np.ndarray, width: int) -> np.ndarray:
    """Positions whose window of ``width`` words lies in one text."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    base = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total, dtype=np.int64) + base


def text_slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text each (or a single longer row)."""
    sizes = np.diff(text_buffers(texts)[1])
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if len(sizes):
        yield at, len(sizes)
