import __spark_entry__


def test_entry_and_registration(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "doc_id" and df.where("decided").count() > 0
