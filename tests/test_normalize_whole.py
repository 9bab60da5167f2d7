import __spark_entry__ as entry
from tests.test_entry import SF, needs_tables


@needs_tables
def test_all_events_are_normalized(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    expected = con.execute(entry.oracle_sql()["normalize_whole"])
    columns = [d[0] for d in expected.description]
    rows = expected.fetchall()
    got = entry.queries()["normalize_whole"](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(rows, key=repr)
    seen = [dict(zip(columns, r, strict=True)) for r in rows]
    assert {r["status"] for r in seen} == {"created", "cancelled", None}
    # Chat rows are there, those with a readable id and those without.
    assert any((r["email"] or "").startswith("g") for r in seen) and any(r["email"] is None for r in seen)
    assert any(r["start_time"] and not r["end_time"] for r in seen) and any(r["end_time"] for r in seen)
