import __spark_entry__ as e


def test_registry():
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 90


def test_entry(spark):
    rows = e.entry(spark).collect()
    assert {r["category"] for r in rows} >= {"(all)", "banking"}
