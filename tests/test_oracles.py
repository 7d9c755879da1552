"""Every registered query with SQL gives the same rows in Spark and DuckDB, at the smallest scale."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tachygraph.oracles import ORACLES
from tachygraph.queries import QUERIES

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, (bool, str)):
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return "nan" if math.isnan(float(v)) else repr(round(float(v), 5) + 0.0)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def test_all_have_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    rows = sorted(tuple(map(norm, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
