import __spark_entry__


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 50
    assert __spark_entry__.entry(spark).count()
