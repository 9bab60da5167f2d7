"""The contract as a table of rules."""

import json

from meetledger.operators.contract import RULE_SCHEMA, contract_problems, default_rules

EMAIL, TELEGRAM = "booking.events.v1.notification.email.message_sent.create", "notification.telegram.message_sent"
AT = "2026-03-01T08:00:00Z"
USUAL = {"booking_uid": "b", "email": "a@x.org", "recipient_role": "client", "trigger_event": "X"}
REJECTION = {
    "booking_uid": "b", "client_email": "a@x.org", "available_from": AT, "has_active_booking": False,
    "previous_meeting_dates": [AT], "rejection_reasons": [], "trigger_event": "BOOKING_REJECTED",
}
CASES = [
    (EMAIL, USUAL, set()),
    (EMAIL, {**USUAL, "job_id": None}, set()),
    (EMAIL, {**USUAL, "job_id": 5, "recipient_role": "guest"}, {("usual", "job_id", "wrong_type"), ("usual", "recipient_role", "not_allowed")}),
    (EMAIL, REJECTION, set()),
    # the telling rule decides, however many others are broken
    (
        EMAIL,
        {**REJECTION, "available_from": "soon", "has_active_booking": "no", "previous_meeting_dates": [AT, "x"], "rejection_reasons": [1], "client_email": None},
        {("rejection", f, "wrong_type") for f in ("available_from", "has_active_booking", "previous_meeting_dates", "rejection_reasons")}
        | {("rejection", "client_email", "missing")},
    ),
    (TELEGRAM, USUAL, {("usual", "recipient_role", "not_allowed")}),
    (TELEGRAM, {**USUAL, "recipient_role": 1}, {("usual", "recipient_role", "wrong_type")}),
    ("booking.rescheduled", {"booking_uid": "b", "start_time": AT, "end_time": "2026-13-01", "previous_booking": None}, {("usual", "end_time", "wrong_type")}),
    ("booking.rescheduled", {"booking_uid": "b", "start_time": AT, "end_time": AT, "previous_booking": {"start_time": 3}}, {("usual", "previous_booking.start_time", "wrong_type")}),
    ("booking.reassigned", {"booking_uid": "b", "user": "x"}, {("usual", "user.email", "missing"), ("usual", "user.time_zone", "missing")}),
    ("chat.deleted", [], {("usual", "booking_uid", "missing")}),
    ("chat.deleted", "not json", {("usual", "booking_uid", "missing")}),
    ("other", {}, set()),
    (None, {}, set()),
]


def test_every_kind_of_problem(spark):
    rows = [(f"e{i}", kind, p if p == "not json" else json.dumps(p)) for i, (kind, p, _) in enumerate(CASES)]
    log = spark.createDataFrame(rows, "event_id string, event_type string, payload_json string")
    got = {}
    for r in contract_problems(log, default_rules(spark)).collect():
        got.setdefault(r["event_id"], []).append((r["shape"], r["field"], r["problem"]))
    for i, (_, _, expected) in enumerate(CASES):
        assert sorted(got.get(f"e{i}", [])) == sorted(expected), CASES[i]


def test_own_rules_deep_paths_and_empty_tables(spark):
    rules = [("t", "one", "a.b.c", "text", False, None, False), ("t", "two", "z", "bool", False, None, False)]
    log = spark.createDataFrame(
        [("1", "t", '{"a":{"b":{"c":"x"}}}'), ("2", "t", '{"z":true}'), ("3", "t", '{"a":{"b":[]}}'), ("4", "t", None)],
        "event_id string, event_type string, payload_json string",
    )
    table = spark.createDataFrame(rules, RULE_SCHEMA)
    got = [tuple(r)[0:1] + tuple(r)[2:] for r in contract_problems(log, table).orderBy("event_id").collect()]
    assert got == [("3", "one", "a.b.c", "missing"), ("4", "one", "a.b.c", "missing")]
    assert contract_problems(log.limit(0), table).count() == 0
    assert contract_problems(log, table.limit(0)).count() == 0


def test_the_log_is_not_shuffled(spark):
    log = spark.range(1000).selectExpr("cast(id as string) event_id", "concat('t', id) event_type", "'{}' payload_json")
    plan = contract_problems(log, default_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan


def test_the_fields_of_a_payload_are_read_once_for_all_rules(spark):
    paths = ["a", "a.b", "a.b.c", "a.", ".a", "", "x", "x.y", "l.0", "v.a"]
    table = spark.createDataFrame([("t", "one", p, "text", False, None, False) for p in paths], RULE_SCHEMA)
    doc = {"a": {"b": {"c": "deep"}, "": "under no name"}, "": {"a": "below no name"}, "x": "text", "l": ["0"], "v": None}
    log = spark.createDataFrame([("1", "t", json.dumps(doc)), ("2", "t", "[1]"), ("3", "t", '"x"')], "event_id string, event_type string, payload_json string")
    problems = contract_problems(log, table)
    got = {}
    for r in problems.collect():
        got.setdefault(r["event_id"], set()).add((r["field"], r["problem"]))
    wrong = {(p, "wrong_type") for p in ("a", "a.b", "")}
    assert got == {"1": wrong | {(p, "missing") for p in ("x.y", "l.0", "v.a")}, **{i: {(p, "missing") for p in paths} for i in "23"}}
    # what meets the rules is the map of the outermost fields, made below the join
    above, below = problems._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")
    assert "parseJson" not in above and below.count("MapType(StringType,VariantType") == 1
