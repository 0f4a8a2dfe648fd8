import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["source_table", "row_id", "line_no", "event_us", "log_level", "component", "n_lines"]
    assert df.limit(1).count() == 1


def test_core_does_not_import_the_llm_package():
    from pathlib import Path

    root = Path(entry.__file__).parent / "tidelog"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tidelog.llm" not in p.read_text(), p
