"""The payload contract as a table of rules, checked without a shuffle of the log.

A rule names the short event type it belongs to, a shape of that type, a dotted path, the
kind of its value, whether it may be absent or null, the allowed texts, and whether it
tells its shape from the others. The rules of a type meet its events by a join with the
rule table, one row per type; the payload is walked along paths that are data, not code.
Its outermost fields are read once for all rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetledger import schemas as S
from meetledger.functions import json_fields as J
from meetledger.functions.times import iso_timestamp
from meetledger.operators import classify

RULE_SCHEMA = "event_type string, shape string, path string, kind string, optional boolean, allowed array<string>, tells boolean"
KINDS = ("text", "time", "bool", "texts", "times")

# a rule table up to this many bytes is sent to all tasks, so that the log stays in place
BROADCAST_BYTES = 8 << 20

_BOTH, _REJECTED = [S.ROLE_ORGANIZER, S.ROLE_CLIENT], "BOOKING_REJECTED"
# fixed values: path -> kind of the payload fields by short event type; ? may be absent or null
_FIELDS = {
    "booking.reminder_sent": {"email": "text"},
    "booking.created": {
        "user.email": "text", "user.time_zone": "text", "client.email": "text", "client.time_zone": "text",
        "start_time": "time", "end_time": "time",
    },
    "booking.rescheduled": {"start_time": "time", "end_time": "time", "previous_booking.start_time": "time?"},
    "booking.reassigned": {"previous_organizer.email": "text?", "user.email": "text", "user.time_zone": "text"},
    "booking.cancelled": {"cancellation_reason": "text?"},
    "chat.created": {"organizer_id": "text", "client_id": "text"},
    "chat.deleted": {},
    "chat.message_sent": {"user_id": "text"},
    "meeting.url_created": {"email": "text", "recipient_role": "text", "meeting_url": "text"},
    "meeting.url_deleted": {"recipient_role": "text"},
    "notification.telegram.message_sent": {"email": "text", "recipient_role": "text", "trigger_event": "text"},
    "notification.email.message_sent": {"email": "text", "job_id": "text?", "recipient_role": "text", "trigger_event": "text"},
}
_REJECTION_MAIL = {
    "job_id": "text?", "client_email": "text", "available_from": "time", "has_active_booking": "bool",
    "active_booking_start": "time?", "previous_meeting_dates": "times", "rejection_reasons": "texts", "trigger_event": "text",
}
_ROLES = {"notification.telegram.message_sent": [S.ROLE_ORGANIZER]}


def default_rules(spark: SparkSession) -> DataFrame:
    """The contract of the known event types; every one of them names its booking."""
    shapes = [(kind, "usual", {"booking_uid": "text", **fields}) for kind, fields in _FIELDS.items()]
    shapes.append(("notification.email.message_sent", "rejection", {"booking_uid": "text", **_REJECTION_MAIL}))
    rows = []
    for event_type, shape, fields in shapes:
        for path, kind in fields.items():
            tells = shape == "rejection" and path == "trigger_event"
            allowed = [_REJECTED] if tells else _ROLES.get(event_type, _BOTH) if path == "recipient_role" else None
            rows.append((event_type, shape, path, kind.rstrip("?"), kind.endswith("?"), allowed, tells))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def fields_of(value: Column) -> Column:
    """The fields of a JSON object by name; NULL for anything else. Asking for its type first would print all its fields."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def value_at(top: Column, names: Column) -> Column:
    """The value under the names of a path, from the fields of the whole document; NULL where something on the way is no object."""
    below = lambda at, name: F.try_element_at(fields_of(at), name)
    first = F.try_element_at(top, F.get(names, F.lit(0)))
    return F.when(F.size(names) == 1, first).otherwise(F.aggregate(F.slice(names, F.lit(2), F.size(names)), first, below))


def _is_of_kind(read: Column) -> Column:
    def single(text: Column, name: str) -> Column:
        return (text if name == "text" else iso_timestamp(text)).isNotNull()

    kind, texts = read["kind"], read["texts"]
    return F.coalesce(
        F.when(kind == "text", single(read["text"], "text"))
        .when(kind == "time", single(read["text"], "time"))
        .when(kind == "bool", read["type"] == "BOOLEAN")
        .when(kind == "texts", F.forall(texts, lambda t: single(t, "text")))
        .when(kind == "times", F.forall(texts, lambda t: single(t, "time"))),
        F.lit(False),
    )


def _problem(read: Column) -> Column:
    problem = (
        F.when(F.coalesce(read["type"], F.lit("VOID")) == "VOID", F.when(~read["optional"], "missing"))
        .when(~_is_of_kind(read), "wrong_type")
        .when(read["allowed"].isNotNull() & ~F.coalesce(F.array_contains(read["allowed"], read["text"]), F.lit(False)), "not_allowed")
    )
    return F.struct(read["path"].alias("field"), problem.alias("problem"), read["tells"].alias("tells"))


def _found(top: Column, rules: Column) -> Column:
    """Problem of each rule, in steps, so that a path is walked and a value looked at once for a rule."""
    valued = F.transform(rules, lambda r: F.struct(r.alias("rule"), value_at(top, r["names"]).alias("value")))
    typed = F.transform(valued, lambda v: F.struct(v["rule"].alias("rule"), v["value"].alias("value"), F.schema_of_variant(v["value"]).alias("type")))
    read = F.transform(
        typed,
        lambda v: F.struct(
            *[v["rule"][c].alias(c) for c in ("path", "kind", "optional", "allowed", "tells")],
            v["type"].alias("type"),
            F.when(v["type"] == "STRING", F.try_variant_get(v["value"], "$", "string")).alias("text"),
            F.when(v["rule"]["kind"].endswith("s"), F.transform(J.elements(v["value"], "$"), lambda e: J.text(e, "$"))).alias("texts"),
        ),
    )
    return F.transform(read, _problem)


def contract_problems(log: DataFrame, rules: DataFrame) -> DataFrame:
    """event_id, event_type, shape, field and problem of every broken rule.

    ``missing``: absent or null though required, also below something that is no object;
    ``wrong_type``: another kind, a time that is none, or a list with such an element;
    ``not_allowed``: a text out of the allowed ones. An event is held against one shape of
    its type: one whose telling rule it keeps, else one that tells nothing, then the one with
    fewest problems, then the first by name. A payload that is no JSON lacks every field.
    Types without rules, and a NULL type, have no problems; no rules, no rows. Rules of one
    type are gathered into one row, so their number must stay that of a contract. A table
    of more than ``BROADCAST_BYTES`` is joined as Spark sees fit instead of being broadcast.
    """
    size = rules.agg(F.sum(F.length(F.to_json(F.struct(*rules.columns))))).first()[0] or 0
    shapes = rules.groupBy(F.col("event_type").alias("_short"), "shape").agg(
        F.sort_array(F.collect_list(F.struct("path", "kind", "optional", "allowed", "tells", F.split("path", r"\.").alias("names")))).alias("rules")
    )
    types = shapes.groupBy("_short").agg(F.sort_array(F.collect_list(F.struct("shape", "rules"))).alias("_shapes"))
    short = F.coalesce(classify.type_action(F.col("event_type")), F.col("event_type"))
    rows = log.select("event_id", "event_type", short.alias("_short"), fields_of(J.parse("payload_json")).alias("_top"))

    found = F.transform("_shapes", lambda s: F.struct(s["shape"].alias("shape"), _found(F.col("_top"), s["rules"]).alias("found")))
    split = F.transform(
        found,
        lambda s: F.struct(
            s["shape"].alias("shape"),
            F.filter(s["found"], lambda v: v["problem"].isNotNull()).alias("broken"),
            F.exists(s["found"], lambda v: v["tells"]).alias("tells"),
        ),
    )
    ranked = F.transform(
        split,
        lambda s: F.struct(
            F.when(F.exists(s["broken"], lambda v: v["tells"]), 2).when(s["tells"], 0).otherwise(1).alias("rank"),
            F.size(s["broken"]).alias("size"),
            s["shape"].alias("shape"),
            s["broken"].alias("broken"),
        ),
    )
    best = rows.join(F.broadcast(types) if size <= BROADCAST_BYTES else types, "_short").select(
        "event_id", "event_type", F.array_min(ranked).alias("_best")
    )
    # a plain explode would make Spark evaluate the checks twice, for a filter on their size
    listed = best.select("event_id", "event_type", F.col("_best.shape").alias("shape"), F.explode_outer("_best.broken").alias("_p"))
    return listed.filter(F.col("_p").isNotNull()).select(
        "event_id", "event_type", "shape", F.col("_p.field").alias("field"), F.col("_p.problem").alias("problem")
    )
