"""Extraction: one pass over the payload of each stored event.

``extract_facts`` parses a payload once and keeps only typed, narrow columns. All
entity and projection operators read these facts, never the payload, so the wide JSON
is read once however many tables are built. Fields of one kind of event are read only
for events of that kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetledger import schemas as S
from meetledger.functions import json_fields as J
from meetledger.functions.hashing import decode_user_id
from meetledger.functions.times import iso_timestamp
from meetledger.operators import classify


def has_booking() -> Column:
    return F.coalesce(F.col("booking_id"), F.lit("")) != ""


# --- which events a projection takes ---


def is_chat() -> Column:
    return (F.col("source") == S.SOURCE_CHAT) | (
        (F.col("source") == S.SOURCE_BOOKING) & F.col("event_type").contains(S.CHAT_TYPE_MARK)
    )


def is_chat_read() -> Column:
    return (F.col("source") == S.SOURCE_CHAT) & (F.col("event_type") == S.CHAT_MESSAGE_READ)


def is_meeting() -> Column:
    return F.col("event_type") == S.MEETING_URL_CREATED


def is_email() -> Column:
    return F.col("event_type").isin(S.EMAIL_SENT, S.MAIL_STATUS)


def is_telegram() -> Column:
    return F.col("event_type") == S.TELEGRAM_SENT


def is_mail_status() -> Column:
    return F.col("event_type") == S.MAIL_STATUS


def is_video() -> Column:
    return F.col("event_type").startswith(S.VIDEO_TYPE_PREFIX)


# --- what is read from a payload ---


def participants(doc: Column) -> Column:
    """Participants in payload order; entries that are no object or lack an e-mail are left out."""
    # one read gives the three fields of every entry, NULL for what it lacks
    entry = "struct<email:variant,role:variant,time_zone:variant>"
    entries = F.try_variant_get(doc, "$.normalized.participants", f"array<{entry}>")
    typed = F.transform(
        F.coalesce(entries, F.array().cast(f"array<{entry}>")),
        lambda p: F.struct(
            J.filled_text(p["email"], "$").alias("email"),
            J.text(p["role"], "$").alias("role"),
            J.text(p["time_zone"], "$").alias("time_zone"),
        ),
    )
    return F.filter(typed, lambda p: p["email"].isNotNull())


def last_with_role(people: Column, role: str) -> Column:
    """E-mail of the last participant with the role."""
    return F.try_element_at(F.filter(people, lambda p: p["role"] == role), F.lit(-1))["email"]


def text_preview(doc: Column, length: int = S.TEXT_PREVIEW_LENGTH) -> Column:
    return F.left(J.text(doc, "$.message.text"), F.lit(length))


def bad_first_user(doc: Column) -> Column:
    """``users`` is a filled array whose first entry is no object: such an event fails."""
    return J.type_name(doc, "$.users[0]").isNotNull() & ~J.is_object(doc, "$.users[0]")


def acting_email(user_email: Column, user_id: Column, decoded_id: Column) -> Column:
    """Who acts in a chat event: first user, then user_id, then the (decoded) user.id."""

    def address(value: Column) -> Column:
        return F.when(F.contains(value, F.lit("@")), value)

    return F.coalesce(user_email, address(user_id), address(decoded_id))


def recipient_email(role: Column, direct: Column, user: Column, organizer: Column, client: Column) -> Column:
    return F.coalesce(
        direct,
        F.when(role == S.ROLE_ORGANIZER, F.coalesce(user, organizer)).when(role == S.ROLE_CLIENT, client),
    )


def pruned_video_payload(action: Column, muted: Column, devices: Column, payload_json: Column) -> Column:
    """The part of a video payload worth keeping for its action, as JSON.

    ``muted`` and ``devices`` are the JSON texts of fields of the right kind, else NULL.
    """

    def kept(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f'{{"{name}":'), value, F.lit("}")), F.lit("{}"))

    return (
        F.when(action.isin("audioMuteStatusChanged", "videoMuteStatusChanged"), kept("muted", muted))
        .when(action == "deviceListChanged", kept("devices", devices))
        .when(action.isin("videoConferenceJoined", "videoConferenceLeft"), F.lit("{}"))
        .otherwise(payload_json)
    )


FACT_BASE = ["event_id", "booking_id", "event_type", "source", "occurred_at", "received_at", "queue"]


def _raw_reads(doc: Column) -> dict[str, Column]:
    """Every field read, once, and only for events of its kind."""
    chat, read, meeting, video = is_chat(), is_chat_read(), is_meeting(), is_video()
    sent, status, telegram = F.col("event_type") == S.EMAIL_SENT, is_mail_status(), is_telegram()
    mail = sent | telegram
    typed = classify.uses_payload_type(F.col("queue"), F.col("source")) & (chat | video)
    fields = {
        "participants": (None, participants(doc)),
        "_start": (None, J.text(doc, "$.normalized.booking.start_time")),
        "_end": (None, J.text(doc, "$.normalized.booking.end_time")),
        "booking_status": (None, J.text(doc, "$.normalized.booking.status")),
        "first_user_role": (mail | chat, J.text(doc, "$.users[0].role")),
        "_bad_user": (mail, bad_first_user(doc)),
        "meeting_url": (meeting, J.text(doc, "$.meeting_url")),
        "_job": (sent, J.text(doc, "$.job_id")),
        "trigger_event": (mail, J.text(doc, "$.trigger_event")),
        "_email": (mail, J.filled_text(doc, "$.email")),
        "_user_email": (mail, J.filled_text(doc, "$.user.email")),
        "_organizer_email": (mail, J.filled_text(doc, "$.organizer.email")),
        "_client_email": (sent, J.filled_text(doc, "$.client.email")),
        "_status_email": (status, J.text(doc, "$.event_data.email")),
        "_status_job": (status, J.text(doc, "$.event_data.job_id")),
        "status": (status, J.text(doc, "$.event_data.status")),
        "clicked_url": (status, J.text(doc, "$.event_data.url")),
        "_status_time": (status, J.text(doc, "$.event_data.event_time")),
        "_type": (typed, J.text(doc, "$.type")),
        "_type_set": (typed, J.is_truthy(doc, "$.type")),
        "_first_email": (chat, J.filled_text(doc, "$.users[0].email")),
        "_user_id": (chat, J.text(doc, "$.user_id")),
        "_chat_id": (chat, J.filled_text(doc, "$.user.id")),
        "_message_id": (chat, J.text(doc, "$.message_id")),
        "_inner_id": (chat, J.text(doc, "$.message.id")),
        "text_preview": (chat, text_preview(doc)),
        "last_read_message_id": (read, J.text(doc, "$.last_read_message_id")),
        "_last_read_set": (read, J.is_present(doc, "$.last_read_message_id")),
        "video_role": (video, J.text(doc, "$.context.user.role")),
        "_video_time": (video, J.text(doc, "$.time")),
        "_muted": (video & J.is_boolean(doc, "$.muted"), J.json_text(doc, "$.muted")),
        "_devices": (video & J.is_object(doc, "$.devices"), J.json_text(doc, "$.devices")),
    }
    return {name: value if gate is None else F.when(gate, value) for name, (gate, value) in fields.items()}


Classifier = Callable[[Column, Column, Column, Column], Column]


def extract_facts(
    log: DataFrame, secret: str | None = None, classifier: Classifier = classify.action, decoder: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Typed facts of every stored event that belongs to a booking.

    ``classifier`` names the action of (queue, source, event type, payload type);
    ``decoder`` opens a chat user id, by default with the secret.
    """
    opened = decoder or (lambda encoded: decode_user_id(encoded, secret))
    parsed = log.filter(has_booking()).select(*FACT_BASE, "payload_json", J.parse("payload_json").alias("_doc"))
    # two steps: reads from the document, then what follows from them, so that no read is
    # repeated where its value is used more than once
    kept = F.when(is_video(), F.col("payload_json")).alias("payload_json")
    raw = parsed.select(*FACT_BASE, kept, *[c.alias(n) for n, c in _raw_reads(F.col("_doc")).items()])

    chat, video = is_chat(), is_video()
    sent, status, telegram = F.col("event_type") == S.EMAIL_SENT, is_mail_status(), is_telegram()
    col = F.col

    def action(source: Column) -> Column:
        return classifier(col("queue"), source, col("event_type"), col("_type"))

    def bad_type(source: Column) -> Column:
        decides = classify.uses_payload_type(col("queue"), source)
        return F.when(decides & col("_type").isNull() & col("_type_set"), "type_not_text")

    # a video event is classified as one whatever its source says
    video_source = F.lit(S.SOURCE_VIDEO)
    chat_id = F.when(col("source") == S.SOURCE_CHAT, opened(col("_chat_id"))).otherwise(col("_chat_id"))
    combined = raw.withColumns(
        {
            "organizer": last_with_role(col("participants"), S.ROLE_ORGANIZER),
            "client": last_with_role(col("participants"), S.ROLE_CLIENT),
            "chat_action": F.when(chat, action(col("source"))),
            "video_action": F.when(video, action(video_source)),
            "_decoded_id": chat_id,
        }
    )
    recipient = recipient_email(
        col("first_user_role"), col("_email"), col("_user_email"), col("_organizer_email"), col("_client_email")
    )
    return combined.select(
        *FACT_BASE,
        "participants",
        "organizer",
        "client",
        iso_timestamp("_start").alias("start_time"),
        iso_timestamp("_end").alias("end_time"),
        "booking_status",
        "first_user_role",
        "meeting_url",
        # e-mail and telegram
        F.coalesce("_job", "_status_job").alias("job_id"),
        "trigger_event",
        F.when(status, col("_status_email")).when(sent | telegram, recipient).alias("recipient_email"),
        "status",
        "clicked_url",
        iso_timestamp("_status_time").alias("status_time"),
        # chat
        "chat_action",
        acting_email(col("_first_email"), col("_user_id"), col("_decoded_id")).alias("acting_email"),
        F.coalesce("_message_id", "_inner_id").alias("message_id"),
        "text_preview",
        "last_read_message_id",
        # video
        "video_action",
        "video_role",
        iso_timestamp("_video_time").alias("video_time"),
        F.when(video, pruned_video_payload(col("video_action"), col("_muted"), col("_devices"), col("payload_json"))).alias(
            "video_payload"
        ),
        # what makes a projection fail for this event
        F.when(
            is_meeting() & F.coalesce("organizer", "client").isNotNull() & col("meeting_url").isNull(), "meeting_url_not_text"
        ).alias("meeting_error"),
        F.when(col("_bad_user") & (telegram | col("_job").isNotNull()), "first_user_not_object").alias("notification_error"),
        F.when(chat, bad_type(col("source"))).alias("chat_error"),
        F.when(video, bad_type(video_source)).alias("video_error"),
        F.when(col("_last_read_set") & col("last_read_message_id").isNull(), "last_read_not_text").alias("read_error"),
    )


# error column -> projection it belongs to
ERROR_COLUMNS = {
    "meeting_error": "meeting_links",
    "notification_error": "notifications",
    "chat_error": "chat_events",
    "video_error": "video_events",
    "read_error": "chat_read_state",
}


def projection_rejects(facts: DataFrame) -> DataFrame:
    """One row per event and projection that could not take it."""
    pairs = F.array(
        *[F.struct(F.lit(name).alias("projection"), F.col(c).alias("reject_reason")) for c, name in ERROR_COLUMNS.items()]
    )
    return (
        facts.filter(F.coalesce(*ERROR_COLUMNS).isNotNull())
        .select("event_id", "booking_id", "event_type", F.inline(F.filter(pairs, lambda p: p["reject_reason"].isNotNull())))
    )
