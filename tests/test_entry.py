import builtins
import sys

import pytest

import __spark_entry__ as contract
from listwright.catalog import QUERIES


@pytest.mark.parametrize("missing", ["sentencepiece", "listwright.llm", "listwright.llm.queries"])
def test_without_a_module_the_other_queries_are_there(monkeypatch, missing):
    for name in [n for n in sys.modules if n.startswith("listwright.llm") or n in ("corpus_pipeline", missing)]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def blocked(name, globals=None, locals=None, fromlist=(), level=0):
        if name == missing or name.startswith(missing + ".") or any(f"{name}.{f}" == missing for f in fromlist or ()):
            raise ImportError(f"No module named {missing!r}")
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", blocked)
    assert set(contract.queries()) == set(QUERIES)
    assert set(contract.oracle_sql()) <= set(QUERIES)
