"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import datetime
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")

SQL = {k: v for k, v in entry.catalog.ORACLE_SQL.items()}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(x, 6) if isinstance(x, float) else x.isoformat() if isinstance(x, datetime.datetime) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", SQL)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(columns)
    want = rows(columns, result.fetchall())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want
    assert want or name == "key_manifest_empty"


def test_every_query_has_sql():
    assert set(entry.catalog.QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
