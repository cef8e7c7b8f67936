"""Every named query of the core against its SQL in DuckDB, over whole tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pagestrata.plans import reference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(reference.ORACLES))
def test_same_rows(spark, duck, name):
    df = reference.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    got = duck.execute(reference.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert mine == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(reference.QUERIES) - set(reference.ORACLES)))
def test_runs(spark, name):
    assert reference.QUERIES[name](spark, SF).count() >= 0


def test_session_order_of_many_and_odd_rows(spark, tmp_path):
    con = duckdb.connect()
    many = "SELECT 'u' || md5(i::VARCHAR) AS id, nullif('s' || (i % 4), 's3') AS session_id, '2026-0' || (1 + i % 7) AS observed_at FROM range(30000) t(i)"
    odd = "('x', 's1', '2026-09'), ('x', 's1', '2025-12'), ('y', 's2', NULL), ('z', 's0', NULL), ('z', 's0', '2026-03'), ('w', NULL, NULL)"
    con.execute(f"COPY ({many} UNION ALL SELECT * FROM (VALUES {odd})) TO '{tmp_path}/unit_observations.parquet'")
    con.execute(f"CREATE VIEW unit_observations AS SELECT * FROM '{tmp_path}/unit_observations.parquet'")
    want = con.execute(f"SELECT id, session_id, position FROM ({reference.ORACLES['session_observation_order']})").fetchall()
    got = reference.QUERIES["session_observation_order"](spark, str(tmp_path)).select("id", "session_id", "position").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
