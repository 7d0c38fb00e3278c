"""Every pN_ query on the smallest test tables: it runs, has its columns, and agrees with its SQL."""

import os

import duckdb
import pytest

from sievewright.llm import queries

COLUMNS = {
    "p1_found": ["row_id", "defect"], "p2_found": ["row_id_a", "row_id_b"], "p3_found": ["row_id", "markup"], "p4_found": ["tbl", "row_id", "field_name"], "p5_found": ["row_id_a", "row_id_b"],
    "p6_found": ["tbl", "row_id"], "p7_found": ["tbl", "row_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = df.collect()
    if name in queries.SQL:
        con = duckdb.connect()
        for f in os.listdir(sf):
            con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
        rel = con.sql(queries.SQL[name])
        cols = sorted(df.columns)
        want = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=str)
        assert sorted((tuple(r[c] for c in cols) for r in rows), key=str) == want
