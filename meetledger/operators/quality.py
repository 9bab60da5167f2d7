"""Event metrics, priorities and contract checks."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetledger import schemas as S
from meetledger.functions import json_fields as J
from meetledger.operators import classify


def event_metrics(log: DataFrame) -> DataFrame:
    """Stored events by queue and type."""
    return log.groupBy("queue", "event_type").agg(
        F.count("*").alias("events"),
        F.count("booking_id").alias("with_booking"),
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
    )


def domain_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(classify.domain(F.col("queue")).alias("domain")).agg(F.count("*").alias("events"))


def reject_metrics(decoded: DataFrame) -> DataFrame:
    """Received and rejected messages by queue, with the share that failed."""
    failed = F.count("reject_reason")
    return decoded.groupBy("queue").agg(
        F.count("*").alias("received"), failed.alias("rejected"), (failed / F.count("*")).alias("error_rate")
    )


# fixed values: priority of an event type; all others are normal
PRIORITY_CRITICAL, PRIORITY_HIGH, PRIORITY_NORMAL, PRIORITY_LOW = 10, 7, 5, 1
EVENT_PRIORITIES = {
    S.BOOKING_CREATED: PRIORITY_CRITICAL,
    S.BOOKING_CANCELLED: PRIORITY_CRITICAL,
    S.EMAIL_SENT: PRIORITY_HIGH,
    S.TELEGRAM_SENT: PRIORITY_HIGH,
    S.CHAT_MESSAGE_NEW: PRIORITY_NORMAL,
    S.MAIL_STATUS: PRIORITY_LOW,
}


def priority(event_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(EVENT_PRIORITIES.items())])
    return F.coalesce(F.try_element_at(table, event_type), F.lit(PRIORITY_NORMAL))


# fixed values: required payload fields by the tail of the event type, as (path, kind)
PAYLOAD_CONTRACT = {
    "booking.reminder_sent": [("$.email", "text")],
    "booking.created": [
        ("$.user.email", "text"),
        ("$.user.time_zone", "text"),
        ("$.client.email", "text"),
        ("$.client.time_zone", "text"),
        ("$.start_time", "text"),
        ("$.end_time", "text"),
    ],
    "booking.rescheduled": [("$.start_time", "text"), ("$.end_time", "text")],
    "booking.reassigned": [("$.user.email", "text"), ("$.user.time_zone", "text")],
    "chat.created": [("$.organizer_id", "text"), ("$.client_id", "text")],
    "chat.message_sent": [("$.user_id", "text")],
    "meeting.url_created": [("$.email", "text"), ("$.recipient_role", "role"), ("$.meeting_url", "text")],
    "meeting.url_deleted": [("$.recipient_role", "role")],
    "notification.telegram.message_sent": [("$.email", "text"), ("$.recipient_role", "role"), ("$.trigger_event", "text")],
    "notification.email.message_sent": [("$.email", "text"), ("$.recipient_role", "role"), ("$.trigger_event", "text")],
}


def _short_type(event_type: Column) -> Column:
    """``booking.events.v1.booking.created.create`` and ``booking.created`` are one type."""
    return F.coalesce(classify.type_action(event_type), event_type)


def contract_violations(log: DataFrame, contract: dict[str, list[tuple[str, str]]] = PAYLOAD_CONTRACT) -> DataFrame:
    """One row per event and required field that is absent or of the wrong kind."""
    doc = F.col("_doc")

    def problem(path: str, kind: str) -> Column:
        value = J.text(doc, path)
        wrong = F.when(~J.is_present(doc, path), "missing").when(value.isNull(), "wrong_type")
        if kind == "role":
            wrong = wrong.when(~value.isin(S.ROLE_ORGANIZER, S.ROLE_CLIENT), "not_allowed")
        return F.struct(F.lit(path).alias("field"), wrong.alias("problem"))

    checks = F
    for name, fields in contract.items():
        checks = checks.when(F.col("_short") == name, F.array(*[problem(p, k) for p, k in fields]))
    rows = log.select(
        "event_id", "event_type", _short_type(F.col("event_type")).alias("_short"), J.parse("payload_json").alias("_doc")
    ).filter(F.col("_short").isin(*contract))
    return rows.select(
        "event_id", "event_type", F.inline(F.filter(checks, lambda c: c["problem"].isNotNull()))
    )
