"""Encoders, the BPE codec, token files: against the tokenizers library, by round trip and by brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from riskloom.llm.bpe_codec import Codec, Merger, bpe_codec, build_automaton, pack_lexicon
from riskloom.llm.token_files import Shard, build_shard, read_token_files, write_token_files
from riskloom.llm.tokens import byte_encoder, word_encoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def odd_texts(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    bits = [*"ab Z9'. \n\t,é́ßΣİ_-\x1c\x85你　  ", "<|endoftext|>", "'s", " the", "<|startoftext|>", "don't", "  ", "xx.", "end,"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(n)]


TEXTS = [*odd_texts(1500), "", "a" * 500, "word " * 3000, "ab" * 200]


@pytest.mark.parametrize("path, make", [(BYTE, byte_encoder), (WORD, word_encoder)])
def test_encoders_give_the_ids_of_the_library(path, make):
    library = Tokenizer.from_file(path)
    ids, first = make(path)(pa.array([*TEXTS, None]))
    for i, t in enumerate([*TEXTS, ""]):
        assert ids[first[i] : first[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_words_that_differ_in_case_or_blanks_are_encoded_once():
    encode = word_encoder.__wrapped__(WORD)  # one that knows no word yet
    given, inner = [], encode._encode
    encode._encode = lambda keys: given.extend(keys) or inner(keys)
    encode(pa.array(["The été the\nTHE Été", "ÉTÉ the", None]))
    assert len(given) == 2
    encode(pa.array(["été\n\nthe"]))
    assert len(given) == 2


def test_letters_beyond_ascii_give_the_ids_of_the_library():
    library = Tokenizer.from_file(WORD)
    letters = [chr(c) for c in [*range(1, 0x250), 0x2C7, 0x391, 0x3A3, 0x3C2, 0x410, 0x1E9E, 0x1E96, 0x212A, 0x212B, 0xFB01, 0xFF21]]
    marks = ["\u0301", "\u0307", "\u030a", "\u030c", "\u0331", "'S", "'ll", ".", "$$$", "7", "<", "<|ENDOFTEXT|>"]
    texts = [t for c in letters for t in (c, f"Aé{c}b", f"{c}{c} H{c}", f"\n{c.upper()}'Re É{c}5É", f" {c}, {c}. ")]
    texts += [a + m for a in (*"AaHTWYJIiÉ", "the ", "") for m in marks] + [f"É{m}{n}é" for m in marks for n in marks]
    encode = word_encoder.__wrapped__(WORD)
    for _ in range(2):  # new, then known
        ids, first = encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_words_forgotten_are_encoded_anew(monkeypatch):
    monkeypatch.setattr("riskloom.llm.tokens.MEMORY", 50)
    library, encode = Tokenizer.from_file(WORD), word_encoder.__wrapped__(WORD)
    for seed in range(12):
        texts = ["", *odd_texts(20, seed % 5), f"same {seed} words"]
        ids, first = encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encode(pa.array([], pa.string()))[0]) == 0 and encode(pa.array(["", None]))[1].tolist() == [0, 0, 0]


def test_codec_gives_the_ids_and_texts_of_the_library():
    library = Tokenizer.from_file(BYTE)
    merge = Merger(BYTE)
    words = sorted({b" the", b"a", b"don", b"'t", b"  ", b" ab", "é".encode(), b"end"})
    codec = Codec(BYTE, pack_lexicon(words, [merge(w) for w in words]))
    ids, first = codec.encode(pa.array(TEXTS))
    for i, (t, back) in enumerate(zip(TEXTS, codec.decode(ids, first))):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[first[i] : first[i + 1]].tolist() == want
        assert back.decode() == library.decode(want, skip_special_tokens=False)


def test_words_merged_together_are_merged_as_alone():
    merge = Merger(BYTE)
    rng = random.Random(4)
    words = ["".join(rng.choices("aethinsrdo é'.", k=rng.randint(0, 45))).encode() for _ in range(3000)] + [b"a" * n for n in range(1, 80)]
    assert merge.many(words) == [merge(w) for w in words]
    assert [merge._long([merge._byte[b] for b in w]) for w in words] == [merge(w) for w in words]


def test_automaton_is_minimal_and_ranks_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 7))).encode() + b"ing" for _ in range(200)})
    first, edges, final = build_automaton(words)
    # states with equal right languages would be equal: count distinct ones by brute force
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    languages = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(final) == len(languages)
    codec = Codec(BYTE, pack_lexicon(words, [[i] for i in range(len(words))]))
    data = np.frombuffer(b"".join(words) + b"abx", np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    assert codec.lexicon.find(data, starts, ends).tolist() == list(range(len(words)))
    assert codec.lexicon.find(data, np.array([ends[-1], 0]), np.array([ends[-1] + 3, 0])).tolist() == [-1, -1]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")


ROWS = [(5, "the end, the end.", 1, "x"), (None, "no id", 1, "x"), (3, None, None, None), (9, "", 0, ""), (5, "the end, the end.", 1, "x"), (1, " é<|endoftext|>", 2, "y")]


def test_codec_query_columns(spark):
    library = Tokenizer.from_file(BYTE)
    got = bpe_codec(rows_of(spark, ROWS), BYTE, words=5).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False).encode()
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe_codec(rows_of(spark, []), BYTE).count() == 0


def test_shard_answers_like_the_list():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 70_000) % 49_408).astype(np.uint16)
    shard = Shard(build_shard(ids, np.array([5, 7]), np.array([30_000, 40_000])))
    assert (shard.ids() == ids).all()
    assert [shard.access(i) for i in (0, 5, 32_767, 32_768, 69_999)] == ids[[0, 5, 32_767, 32_768, 69_999]].tolist()
    for v in (1, 2, 77, 40_000, 49_407):
        places = np.flatnonzero(ids == v)
        assert shard.count(v) == len(places)
        assert shard.count(v, 1000, 50_000) == ((places >= 1000) & (places < 50_000)).sum()
        for k in (0, len(places) // 2, len(places) - 1, len(places)):
            assert shard.select(v, k) == (places[k] if 0 <= k < len(places) else -1)
    empty = Shard(build_shard(np.zeros(0, np.uint16), np.zeros(0, int), np.zeros(0, int)))
    assert len(empty.ids()) == 0 and empty.count(3) == 0 and empty.select(3, 0) == -1


def test_shards_of_several_steps_give_all_ids():
    for n in (1, 65_535, 65_536, 65_537, 150_001):
        ids = np.random.default_rng(n).integers(0, 1 << 16, n).astype(np.uint16)
        assert (Shard(build_shard(ids, np.array([1]), np.array([n]))).ids() == ids).all()


def test_token_files_round_trip(spark):
    library = Tokenizer.from_file(WORD)
    rows = [*ROWS, (-(2**63), "the smallest id", 1, "x"), (77, "a long text of Word999 and more, " * 4000, 1, "x"), *[(100 + i, t.encode("utf-8", "ignore").decode(), 0, "") for i, t in enumerate(TEXTS[:300])]]
    got = read_token_files(write_token_files(rows_of(spark, rows).repartition(3), WORD, shard_tokens=500)).collect()
    want, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert read_token_files(write_token_files(rows_of(spark, []), WORD)).count() == 0
