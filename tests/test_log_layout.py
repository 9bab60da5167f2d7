"""The stored layout of the log: reads by time, booking, type and trace skip files and rows."""

import random
from datetime import datetime, timedelta

import pytest

from meetledger.operators import readers
from meetledger.session import fresh_path
from meetledger.sources.log_layout import read_costs, read_log, write_log

T0 = datetime(2026, 3, 1)
SCHEMA = "event_id string, booking_id string, event_type string, trace_id string, occurred_at timestamp, received_at timestamp, payload string"


def rows(n=6_000):
    rng = random.Random(9)
    made = []
    for i in range(n):
        at = T0 + timedelta(minutes=2 * i)
        # One booking holds a third of the rows, some have none.
        booking = "busy" if i % 3 == 0 else None if i % 50 == 1 else f"b{rng.randrange(300):03d}"
        kind = "rare" if i % 1_000 == 7 else "common"
        made.append((f"e{i:06d}", booking, kind, f"t{rng.randrange(2_000)}", at - timedelta(seconds=5), at, "x" * 20))
    return made


@pytest.fixture(scope="module")
def stored(spark):
    path = fresh_path(spark, "log-layout")
    write_log(spark.createDataFrame(rows(), SCHEMA), path, rows_per_file=50)
    return path


def test_same_rows(spark, stored):
    got = read_log(spark, stored).select("event_id", "booking_id", "event_type", "trace_id", "occurred_at", "received_at", "payload")
    assert sorted(map(tuple, got.collect())) == sorted(rows(), key=lambda r: r[0])


def test_time_prunes_days(spark, stored):
    whole = read_costs(read_log(spark, stored))
    since, until = T0 + timedelta(days=2, hours=3), T0 + timedelta(days=3, hours=1)
    part = read_log(spark, stored, since, until)
    assert {r["event_id"] for r in part.collect()} == {r[0] for r in rows() if since <= r[5] < until}
    costs = read_costs(part)
    assert whole["rows"] == 6_000 and costs["files"] <= whole["files"] / 4 and costs["rows"] <= 2 * 720
    assert "PartitionFilters: [isnotnull(received_day" in part._jdf.queryExecution().toString()


def test_a_booking_reads_its_row_groups(spark, stored):
    found = readers.booking_timeline(read_log(spark, stored), "b123")
    want = [r[0] for r in sorted(rows(), key=lambda r: (r[4], r[0]), reverse=True) if r[1] == "b123"]
    assert [r["event_id"] for r in found.collect()] == want
    assert read_costs(found)["rows"] <= 6_000 / 4
    assert "EqualTo(booking_id,b123)" in found._jdf.queryExecution().toString()


def test_a_rare_type_and_a_trace_read_few_row_groups(spark, stored):
    rare = readers.events_of_type(read_log(spark, stored), "rare")
    # A global sort samples its input first, so everything is read twice.
    assert rare.count() == 6 and read_costs(rare)["rows"] <= 2 * 6 * 50
    trace = readers.events_of_trace(read_log(spark, stored), "t77")
    want = sorted(r[0] for r in rows() if r[3] == "t77")
    assert sorted(r["event_id"] for r in trace.collect()) == want
    assert read_costs(trace)["rows"] <= 2 * len(want) * 50
    assert read_costs(readers.events_of_trace(read_log(spark, stored), "none"))["rows"] == 0


def test_a_busy_booking_is_spread(spark, stored):
    from pyspark.sql import functions as F

    files = read_log(spark, stored).filter("booking_id = 'busy'").select(F.input_file_name().alias("f")).distinct().count()
    assert files >= 9


def test_batches_missing_times_and_empty_logs(spark):
    path = fresh_path(spark, "log-layout")
    data = spark.createDataFrame(rows(50), SCHEMA)
    write_log(data.limit(0), path)
    assert read_log(spark, path, schema=data.schema).collect() == []
    write_log(data, path, mode="append")
    write_log(spark.createDataFrame([("z", None, "common", None, None, None, None)] * 2, SCHEMA), path, mode="append")
    got = read_log(spark, path)
    assert got.count() == 52 and got.filter("received_at IS NULL").count() == 2
    assert read_log(spark, path, since=T0).count() == 50
