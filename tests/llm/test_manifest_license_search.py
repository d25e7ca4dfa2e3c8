"""Manifest, license scan and lexical search against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from riskloom.llm import lexical_search as search_module
from riskloom.llm.lexical_search import lexical_search
from riskloom.llm.license_rules import BASE, KINDS, RULES, WORTH, Rule, compiled
from riskloom.llm.license_scan import detections, license_scan
from riskloom.llm.merkle import FAN, merkle_manifest

from .test_text_operators import LONG, ODD, az_lower, frame

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, row long, rule int, m long, item string"


def documents(spark, rows, parts: int = 3):
    """(doc_id, text, source) with further columns whose names the operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), "t", 1, 2, 3, "x") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, source) -> str:
    values = [doc_id, source, "en", None if text is None else len(text), text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def paths(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root over ``nodes``, and for each of them its siblings before and after, level by level."""
    level, at = nodes, list(range(len(nodes)))
    out: list[list[tuple[str, str]]] = [[] for _ in nodes]
    while len(level) > 1:
        for i, k in enumerate(at):
            low = k // FAN * FAN
            out[i].append(("".join(level[low:k]), "".join(level[k + 1 : low + FAN])))
        level = [sha(*level[i : i + FAN]) for i in range(0, len(level), FAN)]
        at = [k // FAN for k in at]
    return level[0], out


def manifest_by_hand(rows) -> list[tuple]:
    by_source = defaultdict(list)
    for doc_id, text, source in rows:
        leaf = leaf_of(doc_id, text, source)
        chosen = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        changed = leaf_of(doc_id, None if text is None else az_lower(text), source) if chosen else leaf
        if chosen and text is not None:  # the count of characters is not tampered with
            values = [doc_id, source, "en", len(text), az_lower(text)]
            changed = sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])
        by_source[source].append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, changed))
    trees = {}
    for source, leaves in by_source.items():
        leaves.sort()
        trees[source] = paths([x[2] for x in leaves])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, above = paths([trees[s][0] for s in order])
    out = []
    for source, top in zip(order, above):
        subroot, below = trees[source]
        for (_, doc_id, leaf, changed), path in zip(by_source[source], below):
            folded = changed
            for before, after in path + top:
                folded = sha(before, folded, after)
            proof = sha(*[x for pair in path + top for x in pair])
            out.append((doc_id, leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [[1], [5], [16], [17], [1, 2, 16, 40], [300, 257, 1, 600], [5000, 3]])
def test_manifest_against_hand_made_trees(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = []
    for s, size in enumerate(sizes):
        for _ in range(size):
            rows.append((rng.randrange(-5, 10_000), rng.choice(["Text ONE", "text two", "", None, "Ünï X"]), f"source {s}" if s else None))
    mine = merkle_manifest(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in mine), key=repr) == manifest_by_hand(rows)


def test_manifest_over_many_sources_odd_rows_and_no_rows(spark):
    rows = [(i, f"Doc {i}", f"s{i % 300:03d}" if i % 7 else "é" * (i % 5)) for i in range(900)] + list(ODD) * 2
    mine = merkle_manifest(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in mine), key=repr) == manifest_by_hand(rows)
    assert any(not r["verified"] for r in mine) and any(r["verified"] for r in mine)
    assert merkle_manifest(documents(spark, [])).collect() == []


def test_manifest_shows_every_change(spark):
    rows = [(i, f"Doc {i}", "a") for i in range(40)]
    roots = set()
    for k in (None, 0, 17, 39):
        changed = [(i, (t + "!") if i == k else t, s) for i, t, s in rows]
        roots.add(merkle_manifest(documents(spark, changed)).first()["root"])
    assert len(roots) == 4


def scan_by_hand(rows) -> list[tuple]:
    out = []
    for doc_id, text, _ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", az_lower(text))
        normal = " " + "  ".join(words) + " "
        found = []
        for i, r in enumerate(RULES):
            for m in re.finditer(r.pattern, normal):
                found.append((normal[: m.start()].count(" ") // 2, normal[: m.end()].count(" ") // 2, r.kind, i))
        kept = []
        for n, (start, end, kind, i) in enumerate(found):
            if not any(
                s <= start and e >= end and k <= kind and (s, -e, k, j) < (start, -end, kind, i)
                for m, (s, e, k, j) in enumerate(found)
                if m != n
            ):
                kept.append(i)
        base = [
            (at, label)
            for label, phrase in BASE
            for at in range(len(words))
            if words[at : at + len(phrase.split())] == phrase.split()
        ]
        starts = [at for at, _ in base]
        out.append(
            (
                doc_id,
                len(words),
                len(base),
                min(starts, default=None),
                max(starts, default=None),
                ",".join(sorted({x for _, x in base})),
                ",".join(sorted({x for _, x in base} | {RULES[i].label for i in kept})),
                max((WORTH[RULES[i].kind] for i in kept), default=0.0),
            )
        )
    return sorted(out, key=repr)


def sample(pattern: str, rng: random.Random) -> str:
    """A text that the expression matches, for the constructs that the rules use."""
    tree = re._parser.parse(pattern)

    def draw(nodes) -> str:
        text = ""
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                text += chr(arg)
            elif name in ("ANY", "NOT_LITERAL"):
                text += "q"
            elif name == "IN":
                kinds = [a for a in arg if str(a[0]) in ("LITERAL", "RANGE")]
                if kinds:
                    kind, value = rng.choice(kinds)
                    text += chr(value) if str(kind) == "LITERAL" else chr(rng.randint(*value))
                else:
                    text += "q"
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                text += "".join(draw(inner) for _ in range(rng.randint(low, min(high, low + 2))))
            elif name == "BRANCH":
                text += draw(rng.choice(arg[1]))
            elif name == "SUBPATTERN":
                text += draw(arg[3])
            else:
                raise ValueError(name)
        return text

    return draw(tree)


def test_rules_need_the_words_they_name():
    rng = random.Random(3)
    assert len(RULES) >= 200
    for r in RULES:
        for _ in range(20):
            text = sample(r.pattern, rng)
            assert re.fullmatch(r.pattern, text), r
            words = set(text.split())
            assert r.need and set(r.need) <= words, (r, text)


def test_license_scan_against_plain_search(spark):
    rng = random.Random(5)
    rows = list(ODD)
    filler = "lorem ipsum the of Version 2 license public License general gnu under MIT apache cc by".split()
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(" ".join(rng.choices(filler, k=rng.randint(0, 5))))
            parts.append(re.sub(" +", rng.choice([" ", "-", ", ", "\n"]), sample(rng.choice(RULES).pattern, rng)))
        rows.append((100 + i, "".join(x.title() if rng.random() < 0.3 else x for x in parts), "s"))
    rows += [(300, "mit license " * 3000 + "é", "s"), (301, "émit license mit licenseé x-mit-license", "s"), (302, "\x00mit\x7flicense", "s")]
    mine = license_scan(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in mine), key=repr) == scan_by_hand(rows)
    assert license_scan(documents(spark, [])).collect() == []


def test_precedence_and_containment(spark):
    rules = [
        Rule("long", 1, ("a",), compiled("a b c d")),
        Rule("first", 2, ("b",), compiled("b c")),
        Rule("second", 2, ("b",), compiled("b c")),
        Rule("wide", 4, ("z",), compiled("z b c z")),
    ]
    rows = [(1, "a b c d", None), (2, "b c", None), (3, "z b c z", None)]
    _, found = detections(documents(spark, rows), rules)
    kept = {tuple(r) for r in found.filter("kept").select("rule", "start", "end").collect()}
    # the long one hides both; of equal ones the first stays; a weaker kind hides nothing
    assert kept == {(0, 0, 4), (1, 0, 2), (1, 1, 3), (3, 0, 4)}


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def search_by_hand(docs, items, k: int = 10) -> list[tuple]:
    terms = [(i, re.findall(TERM, t or "")) for i, t, *_ in docs]
    terms = [(i, [az_lower(x) for x in w]) for i, w in terms if w]
    n, length = len(terms), sum(len(w) for _, w in terms)
    df = Counter(x for _, w in terms for x in set(w))
    weight = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for x, c in df.items()}
    out = []
    for item, text in items:
        asked = Counter(az_lower(x) for x in re.findall(TERM, text or ""))
        scores = []
        for i, w in terms:
            m, tf = 100 - 75 + (75 * len(w) * n) // length, Counter(w)
            score = sum(c * weight[x] * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m)) for x, c in asked.items() if tf[x])
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("segment", "first", "pairs"), [(1024, 256, 1_000_000), (4, 5, 1_000_000), (16, 1, 60)])
def test_search_against_scoring_everything(spark, monkeypatch, segment, first, pairs):
    monkeypatch.setattr(search_module, "SEGMENT", segment)
    monkeypatch.setattr(search_module, "FIRST", first)
    monkeypatch.setattr(search_module.build_index, "__defaults__", (segment,))
    rng = random.Random(segment)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "7"]
    rows = [(rng.randrange(1000), " ".join(rng.choices(words, k=rng.choice([1, 3, 10, 10, 80]))), "s") for _ in range(300)]
    rows += [(2000 + i, "same w1 w2 copy", "s") for i in range(60)] + list(ODD)
    items = [(i, " ".join(rng.choices([*words, "absent"], k=rng.randint(1, 12)))) for i in range(25)]
    items += [(50, "Same-COPY same"), (51, None), (52, ""), (53, "absent only"), (None, "w3 w4"), (50, "w5"), (54, LONG)]
    table = spark.createDataFrame([(*x, "y", 1) for x in items], "item_id long, text string, item string, row long")
    mine = lexical_search(documents(spark, rows), table, pairs=pairs).collect()
    assert sorted((tuple(r) for r in mine), key=repr) == search_by_hand(rows, items)


def test_search_in_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = frame(spark, ODD)
    assert lexical_search(docs, none).collect() == []
    assert lexical_search(docs.limit(0), one).collect() == []
    assert lexical_search(docs.limit(0), none).columns == ["item_id", "rank", "doc_id", "score"]
