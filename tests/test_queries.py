"""Every query with SQL agrees with it, row by row, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from folioscope.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if pd.isna(x):
        return None
    if isinstance(x, str) or x is True or x is False:
        return str(x)
    return round(float(x), 6)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str([plain(x) for x in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, oracle, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), oracle.execute(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
