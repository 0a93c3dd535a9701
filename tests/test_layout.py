"""The corpus subpackage can be taken away: nothing else in the library names it."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "geoloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_entry_works_without_them(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("geoloom.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("geoloom.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    entry = importlib.reload(__spark_entry__)
    assert "poi_within_radius" in entry.queries() and not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
