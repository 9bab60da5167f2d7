"""Names, fixed values and schemas of the event log."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: sources, roles, queues and event types of the event contract ---
SOURCE_BOOKING = "booking"
SOURCE_CHAT = "getstream"
SOURCE_MAIL = "unisender-go"
SOURCE_VIDEO = "jitsi"

ROLE_ORGANIZER = "organizer"
ROLE_CLIENT = "client"

QUEUE_LIFECYCLE = "events.booking.lifecycle"
QUEUE_CHAT = "events.chat"
QUEUE_VIDEO = "events.jitsi"
QUEUE_DEFAULT = "events.unrouted"

BOOKING_CREATED = "booking.events.v1.booking.created.create"
BOOKING_CANCELLED = "booking.events.v1.booking.cancelled.create"
BOOKING_REASSIGNED = "booking.events.v1.booking.reassigned.create"
BOOKING_REMINDER_SENT = "booking.events.v1.booking.reminder_sent.create"
MEETING_URL_CREATED = "booking.events.v1.meeting.url_created.create"
MEETING_URL_DELETED = "booking.events.v1.meeting.url_deleted.create"
EMAIL_SENT = "booking.events.v1.notification.email.message_sent.create"
TELEGRAM_SENT = "booking.events.v1.notification.telegram.message_sent.create"
MAIL_STATUS = "unisender.events.v1.transactional.status.create"
CHAT_MESSAGE_NEW = "getstream.events.v1.message.new.create"
CHAT_MESSAGE_READ = "getstream.events.v1.message.read.create"
CHAT_CHANNEL_CREATED = "getstream.events.v1.channel.created.create"
CHAT_CHANNEL_DELETED = "getstream.events.v1.channel.deleted.create"

VIDEO_TYPE_PREFIX = "jitsi.events.v1."
VERSION_MARK = ".v1."
CREATE_SUFFIX = ".create"
CHAT_TYPE_MARK = ".chat."
NEW_MESSAGE_ACTION = "message.new"
TEXT_PREVIEW_LENGTH = 512

# queue -> domain
QUEUE_DOMAINS = {
    "events.booking.lifecycle": "booking",
    "events.booking.reminder": "booking",
    "events.chat.lifecycle": "chat",
    "events.chat.activity": "chat",
    "events.chat": "chat",
    "events.meeting.lifecycle": "meeting",
    "events.notification.delivery": "notification",
    "events.mail": "notification",
    "events.jitsi": "video",
}

# binary-mode message header -> envelope column
HEADER_COLUMNS = {
    "ce-id": "event_id",
    "ce-type": "event_type",
    "ce-source": "source",
    "ce-time": "time",
    "ce-booking_id": "booking_id",
    "ce-idempotencykey": "idempotency_key",
    "ce-traceid": "trace_id",
    "ce-spanid": "span_id",
    "ce-dataschema": "dataschema",
}
# --- end of fixed values ---

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.StringType()),
        T.StructField("queue", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
    ]
)

ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("booking_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("queue", T.StringType()),
        T.StructField("payload_json", T.StringType()),
        T.StructField("payload_hash", T.StringType()),
        T.StructField("idempotency_key", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("dataschema", T.StringType()),
    ]
)

ENVELOPE_COLUMNS = ENVELOPE_SCHEMA.fieldNames()

# Arrival order. Every fold and every "first wins" rule uses it.
SEQ = ["received_at", "event_id"]
