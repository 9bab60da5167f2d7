"""Cases that once went wrong: conflicts, time zones, normalization, failing projections."""

import datetime as dt
import json

from pyspark.sql import functions as F

from meetledger.functions.times import iso_timestamp
from meetledger.operators import dedup
from meetledger.plans.normalize import normalize
from meetledger.plans.registry import Projection, Registry
from meetledger.schemas import ENVELOPE_COLUMNS


def events(spark, rows):
    base = dt.datetime(2026, 1, 1)
    full = []
    for i, r in enumerate(rows):
        values = {"event_type": "booking.created", "source": "booking", "booking_id": "b", "payload_json": "{}", "payload_hash": str(i), **r}
        values |= {"received_at": base + dt.timedelta(seconds=i), "occurred_at": base}
        full.append(tuple(values.get(c) for c in ENVELOPE_COLUMNS))
    types = {"received_at": "timestamp", "occurred_at": "timestamp"}
    return spark.createDataFrame(full, ", ".join(f"{c} {types.get(c, 'string')}" for c in ENVELOPE_COLUMNS))


def test_a_rejected_id_claims_no_key(spark):
    rows = [{"event_id": i, "idempotency_key": k} for i, k in (("1", "x"), ("1", "y"), ("2", "y"), ("2", "z"), ("3", "z"), ("4", "x"))]
    log, conflicts = dedup.accept(events(spark, rows), "all", lambda df, _: df)
    assert sorted((r["event_id"], r["idempotency_key"]) for r in log.collect()) == [("1", "x"), ("2", "y"), ("3", "z")]
    assert sorted((r["event_id"], r["idempotency_key"]) for r in conflicts.collect()) == [("1", "y"), ("2", "z")]


def test_accept_moves_whole_rows_once(spark):
    rows = events(spark, [{"event_id": str(i // 2), "idempotency_key": f"k{i // 2}", "payload_json": "x" * 50} for i in range(40)])
    stored = rows.unionByName(rows)
    whole = []

    def keep(df, name):
        if "payload_json" in df.columns:
            whole.append((name, df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()))
        return df

    log, conflicts = dedup.accept(stored, "all", keep)
    assert log.count() == 20 and conflicts.count() == 0
    assert [name for name, _, _ in whole] == ["settled"]
    # the only exchange that carries the payload is the one on the row's identity
    plan = whole[0][2]
    carried = [line for line in plan.splitlines() if "Exchange hashpartitioning(_row" in line]
    assert "WindowGroupLimit" in plan and len(carried) == 2


def test_naive_times_are_utc_in_any_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    texts = ["2026-01-01T00:00:00", "2026-01-01", "2026-01-01T02:00:00+02:00", "20260101T000000", "2026-01-01 00:00", "2026-01-01T00:00:00.0Z"]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(iso_timestamp("t")).alias("at"))
        assert {r["at"] for r in df.collect()} == {1_767_225_600_000_000}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_normalization(spark):
    rows = [
        {"event_id": "1", "source": "getstream", "event_type": "getstream.x", "payload_json": json.dumps({"user": {"id": "opaque-id"}})},
        {"event_id": "2", "payload_json": json.dumps({"users": [], "user": {"email": "o"}, "client": {"email": "c"}})},
        {"event_id": "3", "event_type": "booking.rescheduled", "payload_json": json.dumps({"start_time": "s", "end_time": "e"})},
    ]
    got = {r["event_id"]: json.loads(r["payload_json"])["normalized"] for r in normalize(events(spark, rows), "secret").collect()}
    assert got["1"]["participants"] == []
    assert [p["email"] for p in got["2"]["participants"]] == ["o", "c"]
    assert got["3"]["booking"] == {"start_time": "s", "end_time": "e"}


def test_one_failing_projection_leaves_the_others(spark):
    class Context:
        log = spark.range(3)

    registry = Registry()
    registry.register(Projection("good", F.lit(True), lambda rows, _: rows))
    registry.register(Projection("bad", F.lit(True), lambda rows, _: rows.select("no_such_column")))
    tables = registry.run(Context)
    assert list(tables) == ["good"] and tables["good"].count() == 3 and list(registry.failures) == ["bad"]
