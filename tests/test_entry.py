import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["traj_id", "n", "slope", "rmse"] and df.count() > 0


def test_oracle_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
