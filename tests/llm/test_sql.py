"""The operators that SQL can express, against their SQL."""

import os

import duckdb
import pytest

from tickloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_operator(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toArrow()
    want = db.sql(registry.SQL[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    assert sorted(map(repr, got.select(cols).to_pylist())) == sorted(map(repr, want.select(cols).to_pylist()))
