"""The queries that SQL can express, against their SQL."""

import os

import duckdb
import pytest

from driftwell.llm import queries

DIR = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, DIR)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = want.fetchall()
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(tuple(r[k] for k in place) for r in rows)
