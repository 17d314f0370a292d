"""The registered queries against their SQL counterparts on the smallest data set."""

import duckdb
import pytest

from check import TABLES, rows_of
from __spark_entry__ import EXTRA_QUERIES, entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"

# The training-text queries have tests of their own.
OWN = sorted(set(queries()) - set(EXTRA_QUERIES))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, con, name):
    df = queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name not in oracle_sql():
        assert got
        return
    cursor = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 50
