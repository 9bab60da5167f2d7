"""Read operators: the access paths that users of the tables need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from meetledger.operators.folds import Fold, latest
from meetledger.operators.lookup import left_lookup


def _newest(time: str, tie: str) -> list[Column]:
    return [F.col(time).desc(), F.col(tie).desc()]


def booking_timeline(events: DataFrame, booking_id: str) -> DataFrame:
    """All events of one booking, newest first."""
    return events.filter(F.col("booking_id") == booking_id).orderBy(*_newest("occurred_at", "event_id"))


def timeline_top(events: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events of every booking, ranked."""
    place = Window.partitionBy("booking_id").orderBy(*_newest("occurred_at", "event_id"))
    named = events.filter(F.col("booking_id").isNotNull())
    return named.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= n)


def events_of_type(events: DataFrame, event_type: str, n: int | None = None) -> DataFrame:
    """Events of a type, newest first; the first ``n`` when given."""
    ordered = events.filter(F.col("event_type") == event_type).orderBy(*_newest("occurred_at", "event_id"))
    return ordered.limit(n) if n else ordered


def recent_bookings(bookings: DataFrame, n: int) -> DataFrame:
    return bookings.orderBy(*_newest("last_seen_at", "booking_id")).limit(n)


def of_booking(table: DataFrame, booking_id: str, time: str, tie: str, **equal: str) -> DataFrame:
    """Rows of one booking in a table, newest first, with optional equality filters."""
    wanted = [F.col("booking_id") == booking_id, *[F.col(c) == v for c, v in equal.items()]]
    return table.filter(reduce(lambda a, b: a & b, wanted)).orderBy(*_newest(time, tie))


def organizer_history_of(periods: DataFrame, booking_id: str) -> DataFrame:
    return of_booking(periods, booking_id, "effective_from", "source_event_id")


def meeting_links_of(links: DataFrame, booking_id: str) -> DataFrame:
    return of_booking(links, booking_id, "occurred_at", "source_event_id")


def emails_of(emails: DataFrame, booking_id: str) -> DataFrame:
    return of_booking(emails, booking_id, "sent_at", "job_id")


def emails_by_status_time(emails: DataFrame, status: str | None = None) -> DataFrame:
    """Notifications by the time of their last status, newest first."""
    rows = emails.filter(F.col("last_status") == status) if status else emails
    return rows.orderBy(F.col("last_status_event_time").desc_nulls_last(), F.col("job_id").desc())


def telegrams_of(telegrams: DataFrame, booking_id: str) -> DataFrame:
    return of_booking(telegrams, booking_id, "sent_at", "sent_event_id")


def status_history_of(history: DataFrame, job_id: str) -> DataFrame:
    return history.filter(F.col("job_id") == job_id).orderBy(*_newest("status_event_time", "source_event_id"))


def emails_with_history(emails: DataFrame, history: DataFrame) -> DataFrame:
    """Every status of every notification beside its booking."""
    table = emails.select("job_id", "booking_id", "participant", "trigger_event")
    return history.join(table, "job_id")


def chat_of(chat: DataFrame, booking_id: str, chat_event_type: str | None = None) -> DataFrame:
    equal = {"chat_event_type": chat_event_type} if chat_event_type else {}
    return of_booking(chat, booking_id, "occurred_at", "raw_event_id", **equal)


def video_of(video: DataFrame, booking_id: str, video_event_type: str | None = None) -> DataFrame:
    equal = {"video_event_type": video_event_type} if video_event_type else {}
    return of_booking(video, booking_id, "event_time", "raw_event_id", **equal)


def participants_of_role(participants: DataFrame, role: str) -> DataFrame:
    return participants.filter(F.col("role") == role)


def role_counts(participants: DataFrame) -> DataFrame:
    return participants.groupBy("role").agg(F.count("*").alias("participants"))


def events_of_trace(events: DataFrame, trace_id: str) -> DataFrame:
    return events.filter(F.col("trace_id") == trace_id).orderBy("occurred_at", "event_id")


def links_with_bookings(links: DataFrame, bookings: DataFrame) -> DataFrame:
    """Meeting links beside the state of their booking."""
    table = bookings.select("booking_id", "first_seen_at", "last_seen_at", "current_status")
    return left_lookup(
        links.withColumn("_key", F.col("booking_id")), table, "_key", "booking_id", "source_event_id"
    ).drop("_key")


def latest_per(table: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Newest row per key, as an aggregate."""
    others = [c for c in table.columns if c != key]
    newest = latest(F.struct(*others), order=F.struct(time, tie))
    return Fold([key], {"row": newest}, lambda rows: rows.select(key, "row.*"))(table)
