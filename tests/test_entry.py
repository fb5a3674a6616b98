import __spark_entry__ as entry


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_the_optional_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "shabdagrid"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "shabdagrid.llm" not in p.read_text(encoding="utf-8"), p
