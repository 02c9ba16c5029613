import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) >= 120 and "state_counts" in queries


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and sum(r["n"] for r in rows) > 0
