"""Every registered query with an oracle matches DuckDB (the driver's check)."""

from oracle_harness import check


def test_all_oracle_queries_match_sf0001(spark):
    res = check(spark, "/root/testdata/sf0.001", verbose=False)
    bad = [k for k, ok in res.items() if not ok]
    assert not bad, bad


def test_entry_contract():
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 30
