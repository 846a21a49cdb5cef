"""Every named query with an oracle equals DuckDB on the same files."""

import decimal
import math

import duckdb
import pytest

from quillon.plans import ORACLES, QUERIES
from quillon.plans.registry import TABLES


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in got.collect())
    want = con.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(norm(r[i]) for i in at)) for r in want.fetchall())


def test_names_match():
    assert set(ORACLES) == set(QUERIES) and len(QUERIES) > 140
