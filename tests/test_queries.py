"""Every query of the library with SQL of its own, against DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from corpusflow import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for name in os.listdir(SF):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return db


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    flat = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(flat(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    said = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in said.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, said.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
