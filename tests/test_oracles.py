"""Every query that SQL can express against its oracle; the others give rows."""

import pytest

from grainmill import catalog
from tests.oracle import duck, rows_of_duck, rows_of_spark

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert rows_of_spark(QUERIES[name](spark, SF)) == rows_of_duck(duck(SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_without_llm(monkeypatch):
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("grainmill.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "grainmill.llm" or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "f1_quality" in entry.queries() and not any(q.startswith("op") or q == "pipeline" for q in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
