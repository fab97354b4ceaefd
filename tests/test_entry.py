import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert {r.detector for r in entry.entry(spark).collect()} == {"a", "b"}
