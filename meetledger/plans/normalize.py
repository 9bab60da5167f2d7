"""Normalization of raw payloads to ``{original, normalized}``; off unless asked for.

Raw logs hold participants and booking data in a place that depends on the event type.
This puts them where extraction looks for them, as one conditional expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetledger import schemas as S
from meetledger.functions import json_fields as J
from meetledger.functions.hashing import open_user_id

_PERSON = "array<struct<email:string,role:string,time_zone:string>>"


def _person(email: Column, role: str | None, time_zone: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        email.alias("email"),
        (F.lit(role) if role else none).alias("role"),
        (time_zone if time_zone is not None else none).alias("time_zone"),
    )


def _people(*persons: Column) -> Column:
    """Those with an e-mail. No lambda, under which Spark would interpret every read of the payload."""
    none = F.array().cast(_PERSON)
    return F.concat(*[F.when(p["email"].isNotNull(), F.array(p).cast(_PERSON)).otherwise(none) for p in persons])


def normalized_participants(event_type: Column, source: Column, doc: Column, secret: str | None) -> Column:
    listed = F.filter(
        F.transform(
            J.elements(doc, "$.users"),
            lambda u: F.struct(
                J.filled_text(u, "$.email").alias("email"), J.text(u, "$.role").alias("role"), J.text(u, "$.time_zone").alias("time_zone")
            ),
        ),
        lambda p: p["email"].isNotNull(),
    ).cast(_PERSON)
    named = _people(
        _person(J.filled_text(doc, "$.user.email"), S.ROLE_ORGANIZER, J.text(doc, "$.user.time_zone")),
        _person(J.filled_text(doc, "$.client.email"), S.ROLE_CLIENT, J.text(doc, "$.client.time_zone")),
    )
    # with a secret, an id that cannot be opened names nobody
    chat_id = J.filled_text(doc, "$.user.id")
    chat_person = _person(open_user_id(chat_id, secret) if secret else chat_id, None)
    return (
        F.when(source == S.SOURCE_CHAT, _people(chat_person))
        .when(event_type == S.MAIL_STATUS, _people(_person(J.filled_text(doc, "$.event_data.email"), None)))
        .when(source == S.SOURCE_BOOKING, F.when(F.size(listed) > 0, listed).otherwise(named))
        .otherwise(F.array().cast(_PERSON))
    )


def normalized_booking(event_type: Column, doc: Column) -> Column:
    status = F.when(event_type == S.BOOKING_CREATED, "created").when(event_type == S.BOOKING_CANCELLED, "cancelled")
    timed = event_type.rlike(r"(^|\.)booking\.")
    return F.struct(
        F.when(timed, J.text(doc, "$.start_time")).alias("start_time"),
        F.when(timed, J.text(doc, "$.end_time")).alias("end_time"),
        status.alias("status"),
    )


def normalize(log: DataFrame, secret: str | None = None) -> DataFrame:
    """Envelopes whose payload keeps its top-level keys and gains ``original`` and ``normalized``."""
    doc = F.col("_doc")
    rows = log.withColumn("_doc", J.parse("payload_json"))
    people = F.to_json(normalized_participants(F.col("event_type"), F.col("source"), doc, secret))
    booking = F.to_json(normalized_booking(F.col("event_type"), doc))
    addition = F.concat(
        F.lit('"original":'), F.col("payload_json"),
        F.lit(',"normalized":{"participants":'), people, F.lit(',"booking":'), booking, F.lit("}"),
    )
    body = F.regexp_replace(F.col("payload_json"), r"\A\s*\{\s*|\s*\}\s*\z", "")
    merged = F.concat(F.lit("{"), F.when(body == "", F.lit("")).otherwise(F.concat(body, F.lit(","))), addition, F.lit("}"))
    return rows.withColumn("payload_json", F.when(J.is_object(doc), merged).otherwise(F.col("payload_json"))).drop("_doc")
