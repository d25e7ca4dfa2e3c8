"""The entry works without the parts that may be absent."""

from __future__ import annotations

import re
import sys

import pytest

import __spark_entry__ as entry


def test_queries_without_a_package_that_some_need(monkeypatch):
    core = {name for name in entry.queries() if not re.match(r"op\d", name) and name != "pipeline"}
    for name in [m for m in sys.modules if m.startswith("riskloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for missing in ("zstandard", "tokenizers", "public_tokenizers", "riskloom.llm"):
        monkeypatch.setitem(sys.modules, missing, None)  # importing it raises ImportError
    with pytest.warns(UserWarning, match="left out"):
        assert set(entry.queries()) == core
    with pytest.warns(UserWarning, match="left out"):
        assert set(entry.oracle_sql()) <= core


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
