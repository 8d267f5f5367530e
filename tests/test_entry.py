"""Registered queries: their SQL gives the same rows at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tabweave.plans import catalogue


def rows(df):
    cell = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted(repr([cell(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    assert rows(catalogue.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(catalogue.ORACLES[name]).df())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
