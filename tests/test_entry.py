import builtins
import importlib
import sys

import pytest


def test_entry_and_registry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns == ["primary_id", "n_members", "max_len"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_part(monkeypatch):
    real = builtins.__import__

    def without(name, *a, **k):
        if name == "corpus_pipeline" or name.startswith("loomgrain.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m in ("__spark_entry__", "corpus_pipeline") or m.startswith("loomgrain.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", without)
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    with pytest.raises(ImportError):
        importlib.import_module("corpus_pipeline")
