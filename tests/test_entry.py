import __spark_entry__ as entry


def test_names_and_sql_match():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "q_bulk" in names


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 3000 and {r["verdict"] for r in rows} == {"member", "not_member"}
