"""Encoding whole text columns with a tokenizer file, one distinct piece of text at a time.

A text is cut before every blank or line feed that follows a character which is surely not white space,
and before a comma or full stop that follows an ASCII letter. Neither tokenizer here looks across such
a cut, so the ids of a text are the ids of its pieces one after the other. Only distinct pieces that the worker has not met lately are encoded; all else is looking
up and gathering in numpy and Arrow.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from .words import text_buffers

#: Pieces a worker remembers; beyond it the memory starts anew. Results do not depend on it.
MEMORY = 400_000


def cut_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces of a batch of texts, the piece numbers in text order, and each text's first place."""
    data, offsets = text_buffers(texts)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[at > 0]
    b1 = data[at - 1]
    safe = (b1 > 32) & (b1 < 127)
    wide = np.flatnonzero(b1 >= 128)  # the characters beyond ASCII that are white space end like this
    if len(wide):
        p = at[wide]
        b2, b3 = data[p - 2], data[np.maximum(p - 3, 0)]
        odd = ((b2 == 0xC2) & ((b1[wide] == 0x85) | (b1[wide] == 0xA0))) | (
            ((b3 == 0xE1) & (b2 == 0x9A)) | ((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))) | ((b3 == 0xE3) & (b2 == 0x80))
        )
        safe[wide] = ~odd
    cut = np.zeros(len(data), dtype=bool)
    cut[at[safe]] = True
    at = np.flatnonzero((data == 46) | (data == 44))
    at = at[at > 0]
    before = data[at - 1] | 32
    cut[at[(before >= 97) & (before <= 122)]] = True
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    cuts = np.flatnonzero(cut)
    first = np.searchsorted(cuts, offsets)
    if not len(cuts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), first
    edges = np.append(cuts, len(data)).astype(np.int64)
    buffers = [None, pa.py_buffer(edges), pa.py_buffer(data)]
    coded = pa.LargeStringArray.from_buffers(len(cuts), buffers[1], buffers[2]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first


class PieceEncoder:
    """Turns batches of texts into ids; ``encode`` gives the ids of new distinct pieces.

    Known pieces are numbered; their ids lie in one array, piece after piece.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[Sequence[int]]]):
        self._encode = encode
        self._number: dict[str, int] = {}
        self._ids = np.zeros(0, np.uint16)
        self._first = np.zeros(1, np.int64)
        self._met = np.zeros(0, np.int64)  # batches that had the piece

    def _trim(self) -> None:
        """Forget the pieces met once; the others stay, their counts halved."""
        keep = self._met > 1
        if keep.sum() > MEMORY // 2:
            keep &= self._met > np.median(self._met[keep])
        sizes = np.diff(self._first)
        self._ids = self._ids[np.repeat(keep, sizes)]
        self._first = np.concatenate([[0], np.cumsum(sizes[keep])])
        self._met = self._met[keep] // 2
        stay = [p for p, k in zip(self._number, keep.tolist()) if k]
        self._number = {p: i for i, p in enumerate(stay)}

    def lookup(self, pieces: list[str]) -> np.ndarray:
        """The numbers of the pieces, after encoding those not known yet."""
        if len(self._number) > MEMORY:
            self._trim()
        number = self._number
        missing = [p for p in pieces if p not in number]
        if missing:
            for p in missing:
                number[p] = len(number)
            ids = list(self._encode(missing))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint16, int(sizes.sum()))
            self._first = np.concatenate([self._first, self._first[-1] + np.cumsum(sizes)])
            self._ids = np.concatenate([self._ids, flat])
            self._met = np.concatenate([self._met, np.zeros(len(missing), np.int64)])
        found = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        self._met[found] += 1
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (16 bits each), and the first id of each text."""
        pieces, codes, first = cut_pieces(texts)
        codes = self.lookup(pieces.to_pylist())[codes]
        sizes = np.diff(self._first)[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        # the places of 32 bits suffice for one batch
        shift = np.repeat((self._first[codes] - ends[:-1]).astype(np.int32), sizes)
        shift += np.arange(ends[-1], dtype=np.int32)
        return self._ids[shift], ends[first]


@lru_cache(maxsize=1)
def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write every byte as one printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for c, b in zip([*plain, *range(256, 256 + len(rest))], [*plain, *rest])}


def byte_vocabulary(path: str) -> tuple[list[bytes], dict[str, int], list[tuple[bytes, bytes]]]:
    """The bytes of every id, the added tokens, and the merges of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    added = {a["content"]: a["id"] for a in spec["added_tokens"]}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
    ids = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for t, i in vocab.items():
        ids[i] = raw(t)
    for t, i in added.items():
        ids[i] = t.encode()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return ids, added, [(raw(a), raw(b)) for a, b in merges]


class ByteBpe:
    """Exact byte-level BPE of pieces; added tokens inside a text are ids of their own."""

    def __init__(self, path: str):
        self.bytes_of, self.added, merges = byte_vocabulary(path)
        special = set(self.added.values())
        ranks = {b: i for i, b in enumerate(self.bytes_of) if i not in special}
        made = [ranks[a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError("merges must be listed in the order of their ids")
        self._plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._split = regex.compile("(" + "|".join(regex.escape(t) for t in self.added) + ")") if self.added else None

    def encode(self, pieces: Iterable[str]) -> Iterator[list[int]]:
        plain, lead = self._plain.encode_ordinary, os.path.commonprefix(list(self.added))
        for p in pieces:
            if self.added and lead in p:
                ids: list[int] = []
                for part in self._split.split(p):
                    ids.extend([self.added[part]] if part in self.added else plain(part))
                yield ids
            else:
                yield plain(p)


#: Letters that keep their form under NFC, have one small letter each and are one run to the word rule, together with printable ASCII.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_PLAIN = rf"\A[ -~{_LETTERS}]*\z"
_WORD = rf"\A[{_LETTERS}]+\z"


def _plain(pieces: pa.Array) -> pa.Array:
    """Which pieces consist of printable ASCII and these letters, without the start of a mark."""
    plain = pc.ascii_is_printable(pieces)
    plain = pc.replace_with_mask(plain, pc.invert(plain), pc.match_substring_regex(pieces.filter(pc.invert(plain)), _PLAIN))
    return pc.and_not(plain, pc.match_substring(pieces, "<|"))


def word_keys(pieces: pa.Array) -> pa.Array:
    """The pieces without blanks around them, plain ones in small letters; word-level files give them the same ids."""
    keys = pc.ascii_trim(pieces, " \n")
    return pc.if_else(_plain(keys), pc.utf8_lower(keys), keys)


def _id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of 16-bit ids, ending at ``ends``, as one binary value each: Arrow copies those whole."""
    edges = np.concatenate([[0], 2 * ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(ids))])


class WordBpe:
    """The tokenizer file's own encoding; plain pieces are cut into words first, and distinct words are encoded many to a text."""

    #: Words of one text given to the tokenizer.
    TOGETHER = 100

    def __init__(self, path: str):
        self._whole = Tokenizer.from_file(path)
        self._words = Tokenizer.from_file(path)
        for tokenizer in (self._whole, self._words):
            tokenizer.no_truncation()
            tokenizer.no_padding()
        self._words.normalizer = normalizers.Sequence([])
        self._words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab, suffix = self._words.get_vocab(), self._words.model.end_of_word_suffix
        if not suffix or not all(c in vocab and c + suffix in vocab for c in _byte_letters()):
            raise ValueError("every byte must have an id inside a word and one at its end, so that these part words")
        self._last = np.zeros(1 << 16, bool)  # ids that end a word
        self._last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        small = "a-zß-öø-įı-ſ"
        self._pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{small}]+|[0-9]|[^\s{small}0-9]+")

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's begin."""
        texts = [" ".join(words[i : i + self.TOGETHER]) for i in range(0, len(words), self.TOGETHER)]
        found = [np.array(e.ids, np.uint16) for e in self._words.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint16), *found])
        return flat, np.concatenate([[0], np.flatnonzero(self._last[flat]) + 1])

    def encode(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all distinct keys in a row, and how many each has."""
        plain = _plain(keys)
        alone = pc.and_(plain, pc.match_substring_regex(keys, _WORD))
        # keys as runs of words: each word's key and number
        words, number = keys.filter(alone).to_pylist(), {}
        places, cut = [], []
        mixed = pc.and_not(plain, alone)
        for i, key in zip(np.flatnonzero(mixed).tolist(), keys.filter(mixed).to_pylist()):
            for w in self._pattern.findall(key):
                places.append(i)
                cut.append(number.setdefault(w, len(words) + len(number)))
        ids, first = self._encode_words([*words, *number])
        # other letters, control characters and the marks are left to the file's own rules
        odd = pc.invert(plain)
        rest = [e.ids for e in self._whole.encode_batch_fast(keys.filter(odd).to_pylist(), add_special_tokens=False)]
        extra = np.fromiter(map(len, rest), np.int64, len(rest))
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(rest), np.uint16, int(extra.sum()))])
        owner = np.concatenate([np.flatnonzero(alone), np.array(places, np.int64), np.flatnonzero(odd)])
        used = np.concatenate([np.arange(len(words)), np.array(cut, np.int64), len(first) - 1 + np.arange(len(rest))])
        order = np.argsort(owner, kind="stable")
        owner, used = owner[order], used[order]
        lists = _id_lists(ids, np.concatenate([first[1:], first[-1] + np.cumsum(extra)])).take(pa.array(used))
        flat, ends = _runs(lists)
        return flat, np.bincount(owner, weights=np.diff(ends), minlength=len(keys)).astype(np.int64)


def _runs(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all binary values in a row, and where each begins."""
    if not len(lists):
        return np.zeros(0, np.uint16), np.zeros(1, np.int64)
    edges = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1] // 2
    if edges[-1] == edges[0]:
        return np.zeros(0, np.uint16), edges - edges[0]
    return np.frombuffer(lists.buffers()[2], np.uint16)[edges[0] : edges[-1]], edges - edges[0]


class WordPieceEncoder:
    """Turns batches of texts into ids; ``encode`` gives the ids of new distinct keys in a row and their sizes.

    Known keys and their ids are two Arrow columns; no piece becomes a Python object unless its key is new.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self._encode = encode
        self._keys = pa.array([], pa.large_string())
        self._ids = pa.array([], pa.large_binary())
        self._met = np.zeros(0, np.int64)  # batches that had the key

    def _trim(self) -> None:
        """Forget the keys met once; the others stay, their counts halved."""
        keep = self._met > 1
        if keep.sum() > MEMORY // 2:
            keep &= self._met > np.median(self._met[keep])
        self._keys, self._ids = self._keys.filter(pa.array(keep)), self._ids.filter(pa.array(keep))
        self._met = self._met[keep] // 2

    def lookup(self, keys: pa.Array) -> pa.Array:
        """The ids of the distinct keys, after encoding those not known yet."""
        if len(self._keys) > MEMORY:
            self._trim()
        found = pc.index_in(keys, value_set=self._keys)
        number = found.fill_null(-1).to_numpy().astype(np.int64)
        new = number < 0
        if new.any():
            missing = keys.filter(found.is_null())
            number[new] = len(self._keys) + np.arange(len(missing))
            flat, sizes = self._encode(missing)
            self._keys = pa.concat_arrays([self._keys, missing])
            self._ids = pa.concat_arrays([self._ids, _id_lists(flat, np.cumsum(sizes))])
            self._met = np.concatenate([self._met, np.zeros(len(missing), np.int64)])
        self._met[number] += 1
        return self._ids.take(pa.array(number))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (16 bits each), and the first id of each text."""
        pieces, codes, first = cut_pieces(texts)
        keys = word_keys(pieces).dictionary_encode()
        flat, ends = _runs(self.lookup(keys.dictionary).take(keys.indices).take(pa.array(codes)))
        return flat, ends[first]


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a byte-level BPE file."""
    return PieceEncoder(ByteBpe(path).encode)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordPieceEncoder:
    """The worker's encoder for a word-level BPE file."""
    return WordPieceEncoder(WordBpe(path).encode)
