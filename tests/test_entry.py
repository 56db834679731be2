import __spark_entry__ as E


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.columns == ["pair", "n"]
    assert df.count() > 0
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
