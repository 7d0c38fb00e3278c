"""Every query of the catalogue against its SQL, on the smallest test tables."""

import os

import duckdb
import pytest

from sievewright.plans import catalogue


def canonical(rows):
    def cell(v):
        if hasattr(v, "item") and getattr(v, "ndim", 0) == 0:
            v = v.item()
        if v is None or v != v:
            return None
        return round(v, 5) if isinstance(v, float) else v

    return sorted((tuple(map(cell, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name in catalogue.SQL:
        rel = duck.sql(catalogue.SQL[name])
        assert sorted(rel.columns) == cols
        want = [tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()]
        assert canonical(got) == canonical(want)
