"""The driver contract, and a few queries against their SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from table_queries.oracle import ORACLE
from table_queries.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "event_id" in df.columns


@needs_tables
@pytest.mark.parametrize("name", ["route_by_globs", "dedup_both", "bookings_upsert", "organizer_history_late", "event_chat", "email_notifications"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(expected.fetchall(), key=repr)
