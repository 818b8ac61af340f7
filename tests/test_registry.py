import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from sparkloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if type(v).__name__ in ("bool", "bool_"):
            return bool(v)
        if isinstance(v, str):
            return v
        f = float(v)
        return int(v) if "int" in type(v).__name__ or f == int(f) else f

    df = df[sorted(df.columns)]
    return sorted((tuple(map(one, r)) for r in df.astype(object).itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_other_queries_run(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    assert catalogue.QUERIES[name](spark, SF).count() > 0
