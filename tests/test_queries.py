"""Every query with oracle SQL gives the oracle's rows; every other query runs and keeps its columns."""

import duckdb
import pandas as pd
import pytest

from tracewright.plans import registry
from tracewright.plans.views import TABLES

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, (int, float)):
        return None if v != v else float(v) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(repr([plain(v) for v in r]) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(name, spark, sf, oracle):
    got, want = QUERIES[name](spark, sf).toPandas(), oracle.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    got = QUERIES[name](spark, sf).toPandas()
    # the smallest parts table has no child with more parameters than its parent
    assert len(got.columns) and (len(got) or name == "d08_f_quantiles")
