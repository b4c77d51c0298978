"""Every core query with a SQL counterpart gives the same rows as DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from presswork.plans import oracle, queries, records, records_sql

ALL, SQL = {**queries.QUERIES, **records.QUERIES}, {**oracle.SQL, **records_sql.SQL}


def canon(df):
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return "null"
        number = isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, (bool, np.bool_))
        return repr(float(x)) if number else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    want, got = duck.execute(SQL[name]).df(), ALL[name](spark, data).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, data, name):
    assert ALL[name](spark, data).count() >= 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["chunk_id", "article_id", "article_title", "bm25", "lexical_rank"]
