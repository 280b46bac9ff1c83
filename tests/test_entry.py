import __spark_entry__ as entry


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 50


def test_catalogue():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    if entry.HAS_LLM:
        assert {int(n[2:].split("_")[0]) for n in queries if n.startswith("op")} == set(range(1, 14))
