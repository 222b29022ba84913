"""Every registered query runs on the smallest tables and agrees with its SQL."""

import importlib.util
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).resolve().parents[1]
SF_DIR = pathlib.Path("/root/testdata/sf0.001")
spec = importlib.util.spec_from_file_location("check_oracle", ROOT / "tools" / "check_oracle.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, str(SF_DIR))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    assert sorted(columns) == sorted(df.columns)
    assert {c: check.TYPES[t] for c, t in df.dtypes} == types
    assert check.canonical(rows, df.columns) == check.canonical(cur.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["dataset_id", "kmer", "n", "rank"]
