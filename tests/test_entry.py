import importlib
import sys

import __spark_entry__


def test_queries_and_oracles():
    q = __spark_entry__.queries()
    assert len(q) > 150 and set(__spark_entry__.oracle_sql()) <= set(q)


def test_imports_without_the_training_data_operators(monkeypatch):
    """The entry works where the optional packages are not there."""
    saved = {k: v for k, v in sys.modules.items() if k.startswith("sigloom.llm") or k in ("corpus_pipeline", "__spark_entry__")}

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("sigloom.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for k in saved:
        monkeypatch.delitem(sys.modules, k)
    finder = Missing()
    sys.meta_path.insert(0, finder)
    try:
        entry = importlib.import_module("__spark_entry__")
        assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries()) and len(entry.queries()) > 100
    finally:
        sys.meta_path.remove(finder)
        sys.modules.update(saved)
