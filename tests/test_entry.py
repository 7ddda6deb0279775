import __spark_entry__ as entry


def test_names(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    df = entry.entry(spark)
    assert df.columns == ["seq_id", "n_windows", "n_changes", "pos_sum"] and df.count() == 200
