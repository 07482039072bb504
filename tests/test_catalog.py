"""Every core query runs at the smallest scale, and equals its SQL where it has one."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from velario.plans import catalog


@pytest.fixture(scope="module")
def con(tables):
    c = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 6)
    return int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str(tuple(plain(v) for v in r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", catalog.NAMES)
def test_query(spark, tables, con, name):
    got = catalog.queries()[name](spark, tables).toPandas()
    sql = catalog.oracle_sql().get(name)
    spark.catalog.clearCache()
    if sql:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark, tables):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
