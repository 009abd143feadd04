"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import glob
import math
import os

import pytest

import __spark_entry__

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = __spark_entry__.queries()
SQL = __spark_entry__.oracle_sql()

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(table, columns):
    return sorted(repr(tuple(map(plain, r))) for r in zip(*(table.column(c).to_pylist() for c in columns), strict=True))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF_DIR).toArrow(), duck.sql(SQL[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    columns = sorted(ours.column_names)
    assert rows(ours, columns) == rows(theirs, columns)


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)
