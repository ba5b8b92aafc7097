"""The entry without what the training-data operators need."""

import importlib
import sys

import pytest

from vitrine.plans.registry import QUERIES


def reloaded(monkeypatch, absent):
    for name in [m for m in sys.modules if m in ("corpus_pipeline", "__spark_entry__") or m.startswith("vitrine.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, absent, None)
    entry = importlib.import_module("__spark_entry__")
    del sys.modules["__spark_entry__"]
    return entry


@pytest.mark.parametrize("absent", ["corpus_pipeline", "public_tokenizers"])
def test_other_queries_stay(monkeypatch, absent):
    entry = reloaded(monkeypatch, absent)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) <= set(QUERIES)
