"""Packing and the pipeline against what must hold for any packing, and the stages against brute-force versions."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from riskloom.llm.line_dedup import PASSAGE
from riskloom.llm.packing import Packing, crossover, evolve, pack_documents

from .test_text_operators import ODD, brute_long_lines, brute_quality, corpus, frame, key, rank, words_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_pieces(rows, got, capacity):
    library = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = math.ceil(len(ids) / capacity)
        cut = [0, *range(len(ids) - capacity * (pieces - 1), len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            want.append((doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == key(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    room: list[int] = []  # first-fit decreasing, the plain way
    for length in sorted((w[3] for w in want), reverse=True):
        spot = next((i for i, r in enumerate(room) if r >= length), None)
        if spot is None:
            room.append(capacity - length)
        else:
            room[spot] -= length
    return len(sequences), len(room)


def test_packing_places_every_piece(spark):
    for rows in (ODD, corpus(6, 80)):
        for cell, slack in ((2000, 1.0), (20, 1.1)):  # all pieces in one cell; many small cells and rounds
            got = pack_documents(frame(spark, rows), PATH, capacity=256, cell=cell).collect()
            used, plain = check_pieces([(d, t) for d, t, _ in rows], got, 256)
            assert used <= plain * slack
    assert pack_documents(frame(spark, []), PATH).count() == 0


def test_evolution_never_loses_items_and_does_not_get_worse():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 90, 300).astype(np.int64)
    one = evolve(sizes, 100, 1, [], 4, 0)
    child = crossover(one, evolve(sizes, 100, 2, [], 2, 0), rng)
    for p in (one, child, evolve(sizes, 100, 3, [one], 6, 6)):
        fill = np.bincount(p.bins, weights=sizes)
        assert (p.bins >= 0).all() and fill.max() <= 100 and (p.fill == fill).all()
    assert evolve(sizes, 100, 3, [one], 6, 6).fitness >= one.fitness
    exact = Packing(np.array([60, 50, 50, 40]), 100).best_fit(np.array([0, 1, 2, 3]))
    assert exact.fitness[0] == -2


def test_pipeline_stages_take_effect(spark, tmp_path):
    rows = [(i, t, s) for i, t, s in corpus(8, 80)] + [(200 + i, d[1], d[2]) for i, d in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "secrets", "packing"]

    passed = stages["quality"](spark, docs, str(tmp_path))
    from riskloom.llm.quality_rules import MAX_SHARE, MIN_DOCS, MIN_LEFT

    kept = {r[0] for r in brute_quality(rows, MIN_DOCS, MAX_SHARE, MIN_LEFT) if r[-1]}
    own = [(r.doc_id, r.text, r.source) for r in passed.collect()]
    assert sorted(r[0] for r in own) == sorted(kept) and passed.columns == docs.columns

    lines = stages["lines"](spark, passed, str(tmp_path))
    left, gone = brute_long_lines(own, PASSAGE)
    want = [(d, left[d, t]) for d, t, _ in own if not gone[d, t] or words_of(left[d, t])]
    own = [(r.doc_id, r.text) for r in lines.collect()]
    assert key(own) == key(want) and lines.columns == docs.columns

    near = stages["near_duplicates"](spark, lines, str(tmp_path))
    assert {r.doc_id for r in near.collect()} <= {d for d, _ in own} and near.columns == docs.columns
    clean = stages["secrets"](spark, near, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == near.count()
    packed = stages["packing"](spark, clean, str(tmp_path)).collect()
    check_pieces([(r.doc_id, r.text) for r in clean.collect()], packed, 2048)

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert key(r[:5] for r in whole) == key(r[:5] for r in packed)
    assert sorted({r.doc_id for r in whole}, key=rank) == sorted({r.doc_id for r in packed}, key=rank)


CLASHING = ["spans", "_text", "_rules", "_doc", "_hash", "_id", "_removed", "_host", "_all", "_th", "removed_lines", "_rest", "_body", "_left", "_spans", "a.b", "n_removed", "kept", "th", "row", "node"]


def test_stages_keep_columns_whatever_their_names(spark):
    """Text columns with the names that the operators use come back unchanged from every stage but the last."""
    line = "word " * 25
    rows = [(1, f"{line}\none two\nthree", "s", 3), (2, f"{line}\none two\nthree\nunlike all others " + "x y z " * 30, "s", 3),
            (3, "password = abcdefgh1234 " + "some other words here " * 9, None, 3), (None, None, None, None)]
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    full = [(*r[:2], "en", *r[2:], *[f"{c} {i}" for c in CLASHING]) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, want = stage(spark, docs, ""), stage(spark, plain, "")
        assert out.columns == docs.columns, name
        got = {r["doc_id"]: r for r in out.collect()}
        assert {(r["doc_id"], r["text"], r["n_chars"]) for r in got.values()} == {(r["doc_id"], r["text"], r["n_chars"]) for r in want.collect()}, name
        for i, r in enumerate(full):
            if r[0] in got:
                assert tuple(got[r[0]][5:]) == tuple(r[5:]), (name, i)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 4


def test_pipeline_over_no_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_very_long_texts_pass_the_stages(spark):
    """After the first stage, which drops them, null texts stay null; a very long text is handled whole."""
    long = "\n".join(f"line {i} with words of its own {i * i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, long, "en", "s", len(long)), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert {r.doc_id for r in stages["quality"](spark, docs, "").collect()} == {2}
    for name in ("lines", "near_duplicates", "secrets"):
        assert {(r.doc_id, r.text) for r in stages[name](spark, docs, "").collect()} == {(1, None), (2, long), (3, "")}, name
