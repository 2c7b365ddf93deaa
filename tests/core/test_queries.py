"""Every query with SQL against DuckDB; the subpackage may be missing."""

import glob
import os

import duckdb
import pytest

from corrmatch import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr([r[c] for c in cols]) for r in df.collect())
    if name in queries.ORACLE_SQL:
        cur = tables.execute(queries.ORACLE_SQL[name])
        at = [[c[0] for c in cur.description].index(c) for c in cols]
        assert rows == sorted(repr([r[i] for i in at]) for r in cur.fetchall())


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
