"""Every query with SQL gives the rows of that SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from fieldloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(cell(r[c]) for c in cols) for r in got.collect()), key=str)
    rel = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    at = [names.index(c) for c in cols]
    want = sorted((tuple(cell(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert sorted(names) == cols and rows == want
