from pathlib import Path


def test_entry_imports_without_the_corpus_parts():
    """The entry file is the only place that tolerates the corpus operators being absent."""
    import __spark_entry__ as entry

    names = entry.queries()
    assert "fusion" in names and set(entry.oracle_sql()) <= set(names)
    root = Path(__file__).resolve().parents[1]
    for p in (root / "tidewake").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tidewake.llm" not in p.read_text()
