"""Every query of the catalogue against its SQL on the smallest sample tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from synthspark.plans import queries as catalogue

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(rows, names):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        return (2, f"{float(v):.4f}") if isinstance(v, (int, float)) else (3, str(v))

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    out = catalogue.QUERIES[name](spark, str(DATA))
    want = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(out.columns) == sorted(names)
    assert plain(out.collect(), out.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0
