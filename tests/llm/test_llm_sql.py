"""Queries of this subpackage against their SQL in another engine."""

import glob
import os

import duckdb
import pytest

from clausegrid.llm import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    ran = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    assert got and got == sorted((tuple(r[names.index(c)] for c in columns) for r in ran.fetchall()), key=repr)
