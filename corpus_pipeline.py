"""A training corpus from raw documents: five stages, each an operator of ``riskloom.llm`` that takes effect.

1. quality: documents that fail the base rules, or whose lines are mostly boilerplate of their host, go;
   boilerplate lines go from the others.
2. lines: runs of lines that began earlier in the corpus are deleted, from three lines on, or fewer if they have 50 words
   or are all that a document has; documents that were repeats as a whole go.
3. near_duplicates: of each group of near duplicates the document with the smallest id stays.
4. secrets: found secrets are replaced by their kind in brackets; no document goes.
5. packing: the documents are packed into sequences of at most 2048 tokens.

Each stage works on all that the one before kept. All but the last return the columns of ``documents``;
the last returns one row per piece. ``n_chars`` follows the text where a stage changes it.

Every stage takes whole texts, however long, and keeps further columns as they are, whatever their names. A document with a null
or empty text fails the first stage, as it has fewer than 20 words; given to a later stage, it stays as it is (and packs
as a piece of one token). Null ids are kept; rows that repeat id and text share the first two stages' verdicts and are
one document from the third on. An empty table gives no rows at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, prepare, release, table
from riskloom.llm.line_dedup import PASSAGE, drop_repeated_lines
from riskloom.llm.minhash import drop_near_duplicates
from riskloom.llm.packing import pack_documents
from riskloom.llm.quality_rules import quality_filter
from riskloom.llm.secret_scan import redact_secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now; null texts have none."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the boilerplate lines of their hosts."""
    return _counted(quality_filter(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later repeats."""
    return _counted(drop_repeated_lines(docs, words=PASSAGE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return _counted(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in the sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL cannot run the tokenizer of the last stage; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
