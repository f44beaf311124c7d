"""The pN_ queries over the smallest tables, against SQL where there is one."""

import glob
import os

import duckdb
import pytest

from qirtas.llm import queries

COLUMNS = {
    "p1_found": {"tbl": "string", "key_a": "string", "key_b": "string"},
    "p2_found": {"tbl": "string", "rec_id": "string", "seg": "int", "lang": "string"},
    "p4_found": {"tbl": "string", "rec_id": "string", "item_id": "bigint"},
    "p5_found": {"pair_id": "bigint", "field": "string"},
    "p6_found": {"tbl": "string", "rec_id": "string", "pid": "string", "defect": "string"},
    "p7_found": {"pair_a": "bigint", "pair_b": "bigint"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p10_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_with_its_columns(spark, data, name):
    df = queries.queries()[name](spark, data)
    rows = df.collect()
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
        assert name == "p8_ids" or len({tuple(r) for r in rows}) == len(rows)
    if name in queries.oracle_sql():
        c = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        r = c.execute(queries.oracle_sql()[name])
        cols = [x[0] for x in r.description]
        assert sorted(map(str, ([x[cols.index(k)] for k in df.columns] for x in r.fetchall()))) == sorted(map(str, (list(x) for x in rows)))
