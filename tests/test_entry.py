import __spark_entry__


def test_names_match():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 55


def test_entry_runs(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["conv_id", "turn", "n_context", "prompt_md5", "reference_md5"] and rows.count() > 0
