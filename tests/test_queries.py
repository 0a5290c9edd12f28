"""Every registered query outside the llm subpackage against its SQL on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from driftwell import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROWS_ONLY = set()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return "None" if isinstance(v, float) and math.isnan(v) else repr(float(v))
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def test_all_have_sql():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())


def test_plans_by_chunk_sizes(spark):
    rows = catalogue.QUERIES["partition_auto_split"](spark, DIR).collect()
    totals = {}
    for r in rows:
        assert r.end_row > r.start_row
        totals[r.strategy] = totals.get(r.strategy, 0) + r.end_row - r.start_row
    assert len(totals) == 5 and len(set(totals.values())) == 1
