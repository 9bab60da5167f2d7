"""Reference checks: rows whose parent is missing."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """``child.column`` points to ``parent.parent_column``."""

    child: str
    column: str
    parent: str
    parent_column: str


# fixed values: the references between the tables
REFERENCES = [
    Reference("bookings", "organizer", "participants", "email"),
    Reference("bookings", "client", "participants", "email"),
    Reference("organizer_history", "booking_id", "bookings", "booking_id"),
    Reference("organizer_history", "organizer", "participants", "email"),
    Reference("organizer_history", "source_event_id", "events", "event_id"),
    Reference("meeting_links", "booking_id", "bookings", "booking_id"),
    Reference("meeting_links", "participant", "participants", "email"),
    Reference("meeting_links", "source_event_id", "events", "event_id"),
    Reference("email_notifications", "booking_id", "bookings", "booking_id"),
    Reference("email_notifications", "participant", "participants", "email"),
    Reference("email_notifications", "sent_event_id", "events", "event_id"),
    Reference("email_notifications", "last_status_event_id", "events", "event_id"),
    Reference("telegram_notifications", "booking_id", "bookings", "booking_id"),
    Reference("telegram_notifications", "participant", "participants", "email"),
    Reference("telegram_notifications", "sent_event_id", "events", "event_id"),
    Reference("email_status_history", "job_id", "email_notifications", "job_id"),
    Reference("email_status_history", "source_event_id", "events", "event_id"),
    Reference("chat_events", "booking_id", "bookings", "booking_id"),
    Reference("chat_events", "participant", "participants", "email"),
    Reference("chat_events", "raw_event_id", "events", "event_id"),
    Reference("video_events", "booking_id", "bookings", "booking_id"),
    Reference("video_events", "participant", "participants", "email"),
    Reference("video_events", "raw_event_id", "events", "event_id"),
]


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows of ``child`` whose reference is set and has no parent.

    The child is counted per reference value first, so a value held by many rows moves
    as one row.
    """
    values = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("missing")).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_column).alias("missing"))
    return values.join(known, "missing", "left_anti")


def orphan_report(tables: Mapping[str, DataFrame], references: list[Reference] = REFERENCES) -> DataFrame:
    """Missing values and rows per reference between the given tables, in one pass.

    Every reference turns into rows of (parent column, value, which reference), every parent
    into rows of (parent column, value, none); each table is scanned once for all its
    references. One aggregation by parent column and value counts the rows of each
    reference and tells whether a parent is there. Counts are made before the shuffle, so
    a value that many rows hold moves as one row per task.
    """
    checked = [r for r in references if r.child in tables and r.parent in tables]
    entries = {}
    for number, r in enumerate(checked):
        domain = f"{r.parent}.{r.parent_column}"
        entries.setdefault(r.child, []).append((domain, r.column, number))
        if (domain, r.parent_column, None) not in entries.setdefault(r.parent, []):
            entries[r.parent].append((domain, r.parent_column, None))

    def rows_of(table: str) -> DataFrame:
        each = [
            F.struct(F.lit(domain).alias("domain"), F.col(column).cast("string").alias("value"), F.lit(number).cast("int").alias("reference"))
            for domain, column, number in entries[table]
        ]
        return tables[table].select(F.inline(F.array(*each))).filter(F.col("value").isNotNull())

    every = reduce(DataFrame.union, [rows_of(table) for table in entries])
    counts = [F.count(F.when(F.col("reference") == n, True)).alias(f"r{n}") for n in range(len(checked))]
    values = every.groupBy("domain", "value").agg(F.count(F.when(F.col("reference").isNull(), True)).alias("parents"), *counts)
    named = [
        F.struct(F.lit(r.child).alias("child"), F.lit(r.column).alias("column"), F.lit(r.parent).alias("parent"), F.col("value").alias("missing"), F.col(f"r{n}").alias("rows"))
        for n, r in enumerate(checked)
    ]
    return values.filter("parents = 0").select(F.inline(F.array(*named))).filter("rows > 0")
