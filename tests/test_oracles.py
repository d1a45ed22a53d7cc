"""Every query of the core that has SQL gives the same rows as DuckDB on the smallest data."""

import os

import duckdb
import pandas as pd
import pytest

from quarryframe import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


def _rows(df: pd.DataFrame):
    def text(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, float):
            return f"{x:.6g}"
        return str(x.tolist() if hasattr(x, "tolist") else x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.astype(object).values.tolist())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, db, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = db.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
