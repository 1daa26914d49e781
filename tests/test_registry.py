"""Every registered query runs, has stable columns, and equals its SQL."""

import os
import sys
from glob import glob

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check_oracles import rows_of  # noqa: E402

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["conv_id", "turn", "main", "thread", "prompt"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    assert got
    if name in oracle_sql():
        cursor = db.execute(oracle_sql()[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, cursor.fetchall())
