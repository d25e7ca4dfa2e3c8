"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import bpe_codec
from .common import prepare, table
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .lexical_search import lexical_search
from .license_rules import BASE, KINDS, RULES as SIGNATURES, WORTH
from .license_scan import license_scan
from .line_dedup import PASSAGE, RUN, line_dedup, line_digest
from .merkle import FAN, merkle_manifest
from .minhash import near_duplicates
from .packing import pack_documents
from .quality_rules import MAX_SHARE, MIN_DOCS, MIN_LEFT, quality_rules
from .secret_scan import BASE_RULES, RULES, secret_scan, span_digest
from .substring_dedup import substring_dedup
from .token_files import read_token_files, write_token_files

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query(
    "op7_exact_dedup",
    f"""
    WITH t AS (SELECT doc_id, {_LOWERED} AS norm FROM documents),
         g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
    SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
    FROM t JOIN g ON t.norm = g.norm
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def _spans_sql() -> str:
    """All spans per document: lengths of what lies between matches and of the matches add up to places."""
    parts = []
    for rank, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"""SELECT row, {rank} AS rank, '{r.kind}' AS kind, regexp_extract_all(text, '{pattern}', 0) AS hit,
            regexp_extract_all(text, '{pattern}', {r.group}) AS val, string_split_regex(text, '{pattern}') AS gap, {r.least} AS least
            FROM d WHERE regexp_matches(text, '{pattern}')"""
        )
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    m AS ({" UNION ALL ".join(parts)}),
    i AS (SELECT *, unnest(range(1, len(hit) + 1)) AS k FROM m),
    s AS (SELECT row, rank, kind, length(hit[k]) AS n, length(val[k]) AS vn, least,
          list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:k-1], lambda x: length(x))), 0) AS start
          FROM i),
    g AS (SELECT row, {counts},
          string_agg(concat(kind, ':', start::BIGINT, ':', (start + n)::BIGINT), ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS b,
          string_agg(concat(kind, ':', start::BIGINT, ':', (start + n)::BIGINT), ',' ORDER BY start, rank) AS spans
          FROM s WHERE vn >= least GROUP BY row)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)},
           sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (row)
    """


@_query("op3_secret_scan", _spans_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(secret_scan(table(spark, sf_dir, "documents")))


@_query(
    "op5_quality_rules",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
    i AS (SELECT row, unnest(range(1, len(words) - 6)) AS i, words FROM w),
    win AS (SELECT row, i, array_to_string(words[i:i+7], ' ') AS t FROM i),
    rep AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, t) AS n FROM win) WHERE n > 1),
    cov AS (SELECT row, count(*) AS n_repeat_words FROM (SELECT DISTINCT row, unnest(range(i, i + 8)) AS k FROM rep) GROUP BY row),
    l AS (SELECT row, doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
    lw AS (SELECT row, doc_id, host, line, lower(trim(line, ' ')) AS norm FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    dup AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(norm)) AS total FROM lw GROUP BY row),
    freq AS (SELECT host, norm, count(DISTINCT row) AS n, min(doc_id) AS first FROM lw GROUP BY ALL),
    hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
    lim AS (SELECT host, norm, first FROM freq JOIN hosts USING (host) WHERE n >= {MIN_DOCS} AND n > docs * {MAX_SHARE}::DOUBLE),
    gone AS (SELECT lw.row, sum(length(lw.norm)) AS gone FROM lw JOIN lim USING (host, norm) WHERE lw.doc_id IS DISTINCT FROM lim.first GROUP BY lw.row),
    m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
          length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
          coalesce(n_repeat_words, 0) AS n_repeat_words,
          1 - coalesce(gone, 0)::DOUBLE / greatest(coalesce(total, 0), 1)::DOUBLE AS left_share
          FROM w LEFT JOIN dup USING (row) LEFT JOIN cov USING (row) LEFT JOIN gone USING (row))
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_share >= {MIN_LEFT} AS kept FROM m
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("host", "text_hash", "removed")


@_query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@_query("op4_bpe_codec")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@_query(
    "op8_near_duplicates",
    f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id,
        regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS words FROM documents),
    sh AS (SELECT DISTINCT row, unnest(CASE WHEN len(words) >= 5
        THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))
        WHEN len(words) > 0 THEN [concat(len(words), '|', array_to_string(words, ' '))] ELSE [] END) AS s FROM d),
    n AS (SELECT row, count(*) AS n FROM sh GROUP BY row),
    p AS (SELECT a.row AS a, b.row AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.row <> b.row GROUP BY ALL),
    link AS (SELECT a, b FROM p JOIN n na ON na.row = a JOIN n nb ON nb.row = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
    reach AS (SELECT row AS a, row AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
    least AS (SELECT reach.a AS row, min(d.doc_id) AS component_id FROM reach JOIN d ON d.row = reach.b GROUP BY reach.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM d LEFT JOIN n USING (row) JOIN least USING (row)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("th")


def _long_lines_sql() -> str:
    """Runs of every width up to ``RUN``: shorter ones need ``PASSAGE`` words, or to be all lines of their document."""
    runs = " UNION ALL ".join(
        f"""SELECT doc_id, pos, {k} AS width, list(norm) OVER o AS run, list(ln) OVER o AS lns, sum(words) OVER o >= {PASSAGE} AS long, total FROM w
            WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"""
        for k in range(1, RUN + 1)
    )
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln, unnest(string_split(text, chr(10))) AS line FROM d),
    w AS (SELECT doc_id, ln, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS total,
          regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS norm,
          len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
          FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    r AS (SELECT doc_id, pos, width, run, lns, width = {RUN} OR long AS long FROM ({runs})
          WHERE len(run) = width AND (width = {RUN} OR long OR total = width)),
    f AS (SELECT run, long, min(struct_pack(d := doc_id, p := pos)) AS head FROM r GROUP BY run, long),
    g AS (SELECT r.doc_id, unnest(r.lns) AS ln, unnest(range(pos, pos + width)) AS line_pos, width, head
          FROM r JOIN f ON r.run = f.run AND r.long = f.long WHERE doc_id <> head.d OR pos <> head.p),
    gone AS (SELECT DISTINCT doc_id, ln FROM g WHERE doc_id <> head.d OR line_pos >= head.p + width),
    k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM l ANTI JOIN gone USING (doc_id, ln) GROUP BY l.doc_id),
    c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT d.doc_id, coalesce(c.n, 0) AS n_removed, regexp_matches(coalesce(k.text, ''), '[^\x20\x09-\x0D]') AS kept,
           sha256(coalesce(k.text, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
    """


@_query("op10_line_dedup", _long_lines_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(line_dedup(table(spark, sf_dir, "documents"), words=PASSAGE))


@_query(
    "op10_line_dedup_runs",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln, unnest(string_split(text, chr(10))) AS line FROM d),
    w AS (SELECT doc_id, ln, line, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS pos,
          regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS norm
          FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    r AS (SELECT doc_id, pos, list(norm) OVER o AS run, list(ln) OVER o AS lns, count(*) OVER o AS n FROM w
          WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING)),
    f AS (SELECT run, min(struct_pack(d := doc_id, p := pos)) AS head FROM r WHERE n = {RUN} GROUP BY run),
    g AS (SELECT r.doc_id, unnest(r.lns) AS ln, unnest(range(pos, pos + {RUN})) AS line_pos, pos, head
          FROM r JOIN f ON r.run = f.run WHERE n = {RUN} AND (doc_id <> head.d OR pos <> head.p)),
    gone AS (SELECT DISTINCT doc_id, ln FROM g WHERE doc_id <> head.d OR line_pos >= head.p + {RUN}),
    k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM l ANTI JOIN gone USING (doc_id, ln) GROUP BY l.doc_id),
    c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT d.doc_id, coalesce(c.n, 0) AS n_removed, regexp_matches(coalesce(k.text, ''), '[^\x20\x09-\x0D]') AS kept,
           sha256(coalesce(k.text, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
)
def op10_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(line_dedup(table(spark, sf_dir, "documents")))


@_query(
    "op1_substring_dedup",
    """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    i AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d),
    w AS (SELECT doc_id, i, md5(array_to_string(words[i:i+49], ' ')) AS h FROM i),
    m AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h),
    r AS (SELECT w.doc_id, w.i FROM w JOIN m USING (h) WHERE m.least < w.doc_id),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM r),
    k AS (SELECT doc_id, generate_subscripts(words, 1) AS k, unnest(words) AS word FROM d),
    t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.k) AS text FROM k ANTI JOIN c ON k.doc_id = c.doc_id AND k.k = c.k GROUP BY k.doc_id),
    n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
    SELECT d.doc_id, len(words) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256
    FROM d LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _manifest_sql(levels: int = 7) -> str:
    """The trees level by level, as many as ``levels`` (2**28 rows of a source), and every leaf folded upwards."""
    texts = {"leaf": "text", "tampered": "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"}
    digests = {}
    for name, text in texts.items():
        parts = ", ".join(
            f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR) END"
            for c in ("doc_id", "source", "lang", "n_chars", f"({text})")
        )
        digests[name] = f"sha256(concat({parts}))"
    # the checksum bit by bit: a byte enters with the first of its eight shifts
    shifts = "list_transform(range(8 * length(doc_id::VARCHAR)), lambda i: CASE WHEN i % 8 = 0 THEN ascii((doc_id::VARCHAR)[1 + i // 8]) ELSE 0 END)"
    step = "xor(xor(c, s) >> 1, CASE WHEN xor(c, s) % 2 = 1 THEN 3988292384 ELSE 0 END)"
    crc = f"xor(list_reduce(list_concat([4294967295], {shifts}), lambda c, s: {step}), 4294967295)"

    def tree(t: str) -> str:
        ctes = []
        for k in range(levels):
            ctes.append(
                f"""{t}s{k} AS (SELECT tree, pos, coalesce(string_agg(d, '') OVER (PARTITION BY tree, pos // {FAN} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
                coalesce(string_agg(d, '') OVER (PARTITION BY tree, pos // {FAN} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
                FROM {t}{k} WHERE n > 1)"""
            )
            ctes.append(
                f"""{t}{k + 1} AS (SELECT tree, pos // {FAN} AS pos, (n + {FAN - 1}) // {FAN} AS n, sha256(string_agg(d, '' ORDER BY pos)) AS d
                FROM {t}{k} WHERE n > 1 GROUP BY ALL)"""
            )
        ends = " UNION ALL ".join(f"SELECT tree, d FROM {t}{k} WHERE n = 1" for k in range(levels + 1))
        return ", ".join([*ctes, f"{t}end AS ({ends})"])

    def fold(t: str, source: str, key: str) -> tuple[str, str]:
        ctes = []
        for k in range(levels):
            ctes.append(
                f"""{t}f{k} AS (SELECT f.* REPLACE (CASE WHEN s.pos IS NULL THEN cur ELSE sha256(concat(lft, cur, rgt)) END AS cur,
                concat(proof, lft, rgt) AS proof) FROM {source} f LEFT JOIN {t}s{k} s ON s.tree IS NOT DISTINCT FROM f.{key} AND s.pos = f.{t}pos // {FAN**k})"""
            )
            source = f"{t}f{k}"
        return ", ".join(ctes), source

    first, folded = fold("l", "start", "source")
    second, done = fold("t", "topped", "top")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, {digests["leaf"]} AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN {digests["tampered"]} ELSE {digests["leaf"]} END AS tampered FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS lpos, count(*) OVER (PARTITION BY source) AS n FROM d),
    l0 AS (SELECT source AS tree, lpos AS pos, n, leaf AS d FROM p),
    {tree("l")},
    u AS (SELECT tree AS source, d, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lend),
    t0 AS (SELECT '' AS tree, pos, n, d FROM u),
    {tree("t")},
    start AS (SELECT p.*, '' AS top, u.pos AS tpos, u.d AS subroot, tampered AS cur, '' AS proof FROM p JOIN u ON u.source IS NOT DISTINCT FROM p.source),
    {first},
    topped AS (SELECT * FROM {folded}),
    {second}
    SELECT doc_id, leaf, subroot, tend.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = tend.d AS verified FROM {done}, tend
    """


@_query("op11_merkle_manifest", _manifest_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@_query(
    "op13_lexical_search",
    f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
    q AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark),
    s AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
    p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * max(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
    m AS (SELECT row, doc_id, 100 - 75 + (75 * len(terms) * n) // l AS m FROM d, s),
    t AS (SELECT item, item_id, unnest(terms) AS term FROM q),
    r AS (SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
          FROM t JOIN w USING (term) JOIN p USING (term) JOIN m USING (row) GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
    FROM r WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) <= 10
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _licenses_sql() -> str:
    """Every signature on every text, ungated; base phrases by comparing words."""
    rules = ", ".join(f"({i}, '{r.label}', {r.kind}, {WORTH[r.kind]}::DOUBLE, '{r.pattern}')" for i, r in enumerate(SIGNATURES))

    def place(phrase: str) -> str:
        return " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(" ")))

    base = " UNION ALL ".join(
        f"SELECT row, i - 1 AS start, '{label}' AS label FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM d) WHERE {place(phrase)}"
        for label, phrase in BASE
    )
    wider = " OR ".join(
        f"(kind = {k} AND coalesce(max(CASE WHEN kind <= {k} THEN stop END) OVER o >= stop, false))" for k in range(len(KINDS))
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    n AS (SELECT row, concat(' ', array_to_string(words, '  '), ' ') AS t FROM d),
    r AS (SELECT * FROM (VALUES {rules}) AS v(rule, label, kind, worth, pattern)),
    m AS (SELECT row, rule, label, kind, worth, regexp_extract_all(t, pattern) AS hit, string_split_regex(t, pattern) AS gap
          FROM n, r WHERE regexp_matches(t, pattern)),
    i AS (SELECT *, unnest(range(1, len(hit) + 1)) AS k FROM m),
    p AS (SELECT row, rule, label, kind, worth, (list_sum(list_transform(gap[1:k], lambda x: length(x)))
          + coalesce(list_sum(list_transform(hit[1:k-1], lambda x: length(x))), 0))::BIGINT AS place, hit[k] AS hit FROM i),
    q AS (SELECT p.* EXCLUDE (place, hit), (length(t[1:place]) - length(replace(t[1:place], ' ', ''))) // 2 AS start,
          (length(hit) - length(replace(hit, ' ', ''))) // 2 AS size FROM p JOIN n USING (row)),
    s AS (SELECT *, start + size AS stop FROM q),
    x AS (SELECT *, {wider} AS inside FROM s
          WINDOW o AS (PARTITION BY row ORDER BY start, stop DESC, kind, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS ({base}),
    bg AS (SELECT row, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY row),
    g AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(worth) AS score
          FROM (SELECT row, label, worth FROM x WHERE NOT inside UNION ALL SELECT row, label, 0 FROM b) GROUP BY row)
    SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(score, 0) AS score
    FROM d LEFT JOIN bg USING (row) LEFT JOIN g USING (row)
    """


@_query("op12_license_scan", _licenses_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
