"""Every registered query against its SQL twin, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__
from lanternmill.plans import catalog

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    rows = catalog.queries()[name](spark, TABLES)
    columns = sorted(rows.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in rows.collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in want.fetchall())


def test_entry_point(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
