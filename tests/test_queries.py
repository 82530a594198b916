"""Every query runs on the smallest tables and agrees with its SQL."""

import os

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(SF):
    pytest.skip("no test tables", allow_module_level=True)

from verisift.plans import prose_queries, report_queries, table_queries, text_queries  # noqa: E402

SQL = {**text_queries.SQL, **table_queries.sql(text_queries.SQL), **prose_queries.sql(), **report_queries.sql()}
QUERIES = {**text_queries.QUERIES, **table_queries.QUERIES, **prose_queries.QUERIES, **report_queries.QUERIES}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NA or isinstance(v, float) and v != v:
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def canonical(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF).toPandas()
    if SQL.get(name):
        (a, x), (b, y) = canonical(got), canonical(tables.execute(SQL[name]).df())
        assert a == b and x == y


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
