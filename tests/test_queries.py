"""Every query that has SQL gives the rows of that SQL, at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry
from grove.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
key = lambda r: tuple((x is not None, x) for x in r)


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_rows(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = sql.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})")
    assert sorted(map(tuple, df.select(columns).collect()), key=key) == sorted(map(tuple, want.fetchall()), key=key)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert tuple(entry.entry(spark).first()) == (2_995_308, 24)
    assert set(entry.oracle_sql()) <= set(entry.queries())
