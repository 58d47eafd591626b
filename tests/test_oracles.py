"""Every query that SQL can express, against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
NAMES = [n for n in contract.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return f"{x:.5g}"
    if hasattr(x, "isoformat"):
        return str(x)[:19]
    return str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    got = df.collect()
    want = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_every_query_is_callable_and_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert all(callable(f) for f in contract.queries().values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_entry(spark):
    assert contract.entry(spark).count() > 0
