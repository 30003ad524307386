"""Every query of the engine against its SQL."""

import pytest

from orthant.plans import registry
from tests.compare import differs, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, name):
    assert differs(registry.queries()[name](spark, FOLDER), duck(FOLDER), registry.oracle_sql()[name]) == ""


def test_entry_without_llm(monkeypatch, spark):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(__spark_entry__)
    assert set(alone.queries()) == set(registry.queries()) and set(alone.oracle_sql()) == set(registry.oracle_sql())
    assert alone.entry(spark).count() > 0
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
