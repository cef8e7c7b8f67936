"""The numbered queries over whole tables: their columns, and the SQL where there is one."""

import glob
import os

import duckdb
import pytest

from pagestrata.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": [("blob_id_a", "string"), ("blob_id_b", "string")],
    "p2_found": [("record_table", "string"), ("record_id", "string")],
    "p3_found": [("record_table", "string"), ("record_id", "string"), ("pii_type", "string"), ("mention_no", "int")],
    "p4_found": [("evidence_block_id", "string"), ("line_no", "int")],
    "p5_found": [("record_table", "string"), ("record_id", "string"), ("block_no", "int")],
    "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_no_repeats(spark, name):
    df = Q.queries()[name](spark, SF)
    assert df.dtypes == COLUMNS[name]
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(COLUMNS)))
def test_runs(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = Q.queries()[name](spark, SF)
    got = con.execute(Q.oracle_sql()[name])
    assert [d[0] for d in got.description] == df.columns
    assert {tuple(r) for r in df.collect()} == set(got.fetchall())
