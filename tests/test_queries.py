"""Every registered query runs on the smallest tables; those with SQL agree with DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
MAY_BE_EMPTY = {"cls_10_nearest_centroid", "ag_08_centroids"}  # too few vectors per label on the smallest tables


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        problem = compare(df, duck, SQL[name])
        assert problem is None or (problem == "EMPTY" and name in MAY_BE_EMPTY), problem
    else:
        assert df.columns and df.count() > 0
