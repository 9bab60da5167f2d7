"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetledger import schemas as S
from meetledger.functions import hashing, times
from meetledger.functions import json_fields as J
from meetledger.operators import classify, contract, dedup, entities, extract, integrity, quality, readers
from meetledger.operators import projections as P
from meetledger.operators.folds import Fold, first, greatest, latest
from meetledger.operators.routing import DEFAULT_RULES, Rule, destinations, effective_queues, route, route_by_table
from meetledger.plans import normalize as N
from meetledger.plans import pipeline
from meetledger.plans.registry import FoldedProjection, Projection, Registry
from meetledger.schemas import MESSAGE_SCHEMA
from meetledger.session import PACKED, fresh_path, materialize
from meetledger.sources import messages as M
from meetledger.sources.key_index import KeyIndex
from meetledger.sources.publish import outgoing_messages
from meetledger.sources.tables import TableStore
from meetledger.streaming.ingest import FOLDS, StreamIngest
from meetledger.streaming.state import StateTable
from table_queries.adapters import conversation_log, event_headers, event_log, iso, laid_out, mail_log, order_log, plain, raw_events, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = lambda spark, sf_dir: plain(build(spark, sf_dir))
    return build


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(event_log(spark, sf_dir))


# facts that the operators of one kind read
PEOPLE = ["event_id", "received_at", "participants"]
BOOKINGS = ["booking_id", "event_id", "occurred_at", "received_at", "queue", "start_time", "end_time", "booking_status", "organizer", "client"]
LINKS = ["booking_id", "event_id", "event_type", "occurred_at", "received_at", "organizer", "client", "meeting_url", "meeting_error"]
STATUSES = ["event_id", "event_type", "received_at", "job_id", "status", "status_time"]
MAILS = [
    *STATUSES, "booking_id", "occurred_at", "organizer", "client", "first_user_role", "trigger_event", "recipient_email", "clicked_url",
    "notification_error",
]
CHAT = [
    "booking_id", "event_id", "event_type", "source", "occurred_at", "received_at", "organizer", "client", "first_user_role", "chat_action",
    "acting_email", "message_id", "text_preview", "last_read_message_id", "chat_error", "read_error",
]


def _facts_of(log: DataFrame, *columns: str) -> DataFrame:
    """Facts are a stored table too: several operators read them, the payload is parsed once.

    With ``columns`` only these are read from the payload and stored.
    """
    facts = extract.extract_facts(log)
    return materialize(facts.select(*dict.fromkeys(columns)) if columns else facts, "facts")


def _facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _facts_of(_stored(spark, sf_dir), *columns)


ID = ["event_id", "booking_id", "event_type", "source"]

# --- sources and sinks ---


@query
def decode_messages(spark, sf_dir):
    """SRC2, SRC5, TIM1, HSH1"""
    decoded = M.valid_envelopes(M.decode_messages(event_headers(spark, sf_dir), hash_mode="text"))
    return decoded.select(*ID, "occurred_at", "received_at", "queue", "payload_json", "payload_hash", "idempotency_key", "trace_id", "span_id")


@query
def rejected_messages(spark, sf_dir):
    """SRC3, DOC3"""
    return M.rejected_messages(M.decode_messages(event_headers(spark, sf_dir))).select(
        "reject_reason", "queue", "event_id", "event_type", "source", "raw_time", "body"
    )


@query
def reject_metrics(spark, sf_dir):
    """DOC7"""
    return quality.reject_metrics(M.decode_messages(event_headers(spark, sf_dir)))


@query
def queue_messages(spark, sf_dir):
    """SRC1, RTE5: only the queues asked for"""
    wanted = effective_queues(explicit=["events.chat", "events.mail"])
    return M.select_queues(event_headers(spark, sf_dir), wanted).groupBy("queue").agg(F.count("*").alias("messages"))


@query
def publish_messages(spark, sf_dir):
    """SNK2"""
    out = outgoing_messages(raw_events(spark, sf_dir).withColumn("payload_json", F.col("props")))
    header = lambda name: F.try_element_at("headers", F.lit(name))
    return out.select(
        "routing_key",
        header("ce-id").alias("ce_id"),
        header("ce-type").alias("ce_type"),
        header("ce-source").alias("ce_source"),
        header("ce-time").alias("ce_time"),
        header("ce-booking_id").alias("ce_booking_id"),
        F.size("headers").alias("header_count"),
        "body",
        "content_type",
        "message_type",
    )


# --- routing and classification ---


@query
def route_events(spark, sf_dir):
    """RTE1-3"""
    return route(raw_events(spark, sf_dir)).select("event_id", "routing_key")


GLOB_RULES = [
    Rule("chat-new", "get?tream", "*.message.new.*"),
    Rule("video", "jitsi-[a-e]u", "jitsi.events.v1.[!d]*"),
    Rule("devices", "jitsi*", "*[Dd]evice*"),
    Rule("dotless", "*", "billing?v1.charge.create"),
    Rule("odd", "[!b]*", "*.create"),
]


@query
def route_by_globs(spark, sf_dir):
    """RTE1, RTE2 with every kind of pattern"""
    return route(raw_events(spark, sf_dir), GLOB_RULES, default="rest").select("event_id", "routing_key")


@query
def route_by_rule_table(spark, sf_dir):
    """RTE2 with rules as a table: the glob rules, then one rule for every type that occurs"""
    raw = raw_events(spark, sf_dir)
    globs = [(i, r.destination, r.source_pattern, r.type_pattern) for i, r in enumerate(GLOB_RULES)]
    own = raw.select(
        (F.xxhash64("event_type").bitwiseAND((1 << 40) - 1) + 100).alias("rule_no"), F.concat(F.lit("of:"), "event_type").alias("destination"),
        F.lit("*").alias("source_pattern"), F.col("event_type").alias("type_pattern"),
    ).distinct()
    rules = spark.createDataFrame(globs, "rule_no long, destination string, source_pattern string, type_pattern string").unionByName(own)
    return route_by_table(raw, rules, default="rest").select("event_id", "routing_key")


@query
def route_counts(spark, sf_dir):
    """RTE2"""
    return route(raw_events(spark, sf_dir)).groupBy("routing_key").agg(F.count("*").alias("events"))


@query
def destination_counts(spark, sf_dir):
    """RTE4: every destination, with the events that reach it"""
    counts = route(raw_events(spark, sf_dir)).groupBy(F.col("routing_key").alias("destination")).agg(F.count("*").alias("n"))
    return destinations(spark, DEFAULT_RULES).join(counts, "destination", "left").select("destination", F.coalesce("n", F.lit(0)).alias("events"))


@query
def classify_events(spark, sf_dir):
    """CLS1-5"""
    kind = F.when(F.col("event_type") == S.CHAT_MESSAGE_NEW, "message.new").when(F.col("k") % 4 == 0, "")
    return raw_events(spark, sf_dir).select(
        "event_id", classify.action(F.col("queue"), F.col("source"), F.col("event_type"), kind).alias("action")
    )


@query
def domain_counts(spark, sf_dir):
    """CLS6"""
    return quality.domain_counts(raw_events(spark, sf_dir))


# --- deduplication ---


@query
def dedup_content(spark, sf_dir):
    """DED2"""
    return dedup.dedup_by_content(event_log(spark, sf_dir)).select(*ID, "received_at", "payload_hash")


@query
def dedup_idempotency(spark, sf_dir):
    """DED1"""
    return dedup.dedup_by_key(event_log(spark, sf_dir)).select(*ID, "idempotency_key", "received_at")


@query
def dedup_history(spark, sf_dir):
    """DED3, WIN1"""
    return dedup.dedup_history(event_log(spark, sf_dir)).select(*ID, "payload_hash", "received_at")


@query
def dedup_both(spark, sf_dir):
    """DED1 and DED2 together, SNK1, FLT1"""
    return _stored(spark, sf_dir).select(*ID, "idempotency_key", "payload_hash", "received_at")


@query
def dedup_unkeyed_scope(spark, sf_dir):
    """DOC2"""
    return dedup.deduplicate(event_log(spark, sf_dir), legacy_scope="unkeyed").select(*ID, "idempotency_key", "received_at")


@query
def dedup_incremental(spark, sf_dir):
    """DED6: events after a date against the log before it"""
    log = event_log(spark, sf_dir)
    border = F.lit("2024-01-16 00:00:00").cast("timestamp")
    late = log.filter(F.col("received_at") >= border)
    index = KeyIndex(TableStore(spark, fresh_path(spark, "store")))
    commit = index.store.begin()
    index.add(commit, dedup.deduplicate(log.filter(F.col("received_at") < border)))
    commit.publish()
    fresh = dedup.drop_stored(late, index.sharing(late))
    return dedup.deduplicate(fresh).select(*ID, "idempotency_key", "received_at")


def _reused_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which two users of the same hour share an event id."""
    log = raw_events(spark, sf_dir)
    shared = F.concat_ws("-", F.date_format("received_at", "yyyyMMddHH"), (F.col("user_id") % 100).cast("string"))
    return log.withColumn("event_id", shared).withColumn("payload_json", F.col("props")).select(*S.ENVELOPE_COLUMNS)


@query
def id_conflicts(spark, sf_dir):
    """DED4"""
    return dedup.split_id_conflicts(_reused_ids(spark, sf_dir))[1].select("event_id", "received_at", "event_type", "reject_reason")


@query
def id_first(spark, sf_dir):
    """DED4: the rows that stay"""
    return dedup.split_id_conflicts(_reused_ids(spark, sf_dir))[0].select("event_id", "received_at", "event_type")


@query
def insert_once(spark, sf_dir):
    """DED5: a repeated run adds only what the first one lacked"""
    video = P.video_events(_facts(spark, sf_dir))
    border = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return P.new_rows(video, video.filter(F.col("received_at") < border)).select("raw_event_id", "booking_id", "video_event_type")


# --- extraction ---


@query
def payload_fields(spark, sf_dir):
    """Typed reads: a number is no text"""
    doc = J.parse("props")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.try_variant_get(doc, "$.k", "bigint").alias("k_number"),
        J.text(doc, "$.k").alias("k_text"),
        J.text(doc, "$.absent").alias("absent"),
        J.is_object(doc).alias("is_object"),
        J.is_truthy(doc, "$.k").alias("k_truthy"),
    )


@query
def event_participants(spark, sf_dir):
    """EXT1, FLT2"""
    return entities.participant_rows(_facts(spark, sf_dir)).select("event_id", "pos", "email", "role", "time_zone")


@query
def event_bookings(spark, sf_dir):
    """EXT2, EXT3, TIM2"""
    return _facts(spark, sf_dir).select("event_id", "booking_id", "organizer", "client", "start_time", "end_time", "booking_status")


@query
def chat_fields(spark, sf_dir):
    """EXT4, EXT5, EXT7, EXT8, FLT3"""
    return (
        _facts(spark, sf_dir)
        .filter(extract.is_chat())
        .select("event_id", "chat_action", "message_id", "acting_email", "first_user_role", F.md5("text_preview").alias("preview_hash"))
    )


@query
def custom_classifier(spark, sf_dir):
    """UDF2: actions named by the user's own classifier"""
    log = _stored(spark, sf_dir)
    facts = extract.extract_facts(log, classifier=lambda queue, source, event_type, _: F.concat_ws("/", source, event_type))
    return facts.filter(extract.is_chat()).select("event_id", "chat_action")


@query
def read_fields(spark, sf_dir):
    """EXT6, FLT4"""
    return _facts(spark, sf_dir).filter(extract.is_chat_read()).select("event_id", "acting_email", "last_read_message_id")


@query
def notification_fields(spark, sf_dir):
    """EXT9, EXT10, EXT13, FLT6-8"""
    return (
        _facts(spark, sf_dir)
        .filter(extract.is_email() | extract.is_telegram())
        .select("event_id", "job_id", "trigger_event", "recipient_email", "status", "clicked_url", "status_time")
    )


@query
def video_fields(spark, sf_dir):
    """EXT11, EXT12, FLT9"""
    return (
        _facts(spark, sf_dir)
        .filter(extract.is_video())
        .select("event_id", "video_action", "video_role", "video_time", F.when(F.col("video_action") != F.col("event_type"), F.col("video_payload")).alias("kept"))
    )


@query
def projection_rejects(spark, sf_dir):
    """FLT11, D12"""
    return extract.projection_rejects(_facts(spark, sf_dir)).select("event_id", "projection", "reject_reason")


# --- entities ---


@query
def participants_upsert(spark, sf_dir):
    """EXT1, AGG1, PRJ8"""
    return entities.participants(_facts_of(order_log(spark, sf_dir))).select(
        "email", "role", "time_zone", F.col("first_seq")["event_id"].alias("first_event_id")
    )


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts = _facts_of(order_log(spark, sf_dir))
    border = F.lit("1998-01-01 00:00:00").cast("timestamp")
    old = entities.participants(facts.filter(F.col("received_at") < border))
    new = entities.participants(facts.filter(F.col("received_at") >= border))
    return old, new


@query
def participants_changed(spark, sf_dir):
    """AGG2"""
    old, new = _halves(spark, sf_dir)
    return entities.changed_participants(new, old).select("email", "role", "time_zone")


@query
def participants_merge(spark, sf_dir):
    """AGG3"""
    return entities.merge_participants(*_halves(spark, sf_dir))


@query
def bookings_upsert(spark, sf_dir):
    """AGG4, AGG5, PRJ9"""
    return entities.bookings(_facts_of(order_log(spark, sf_dir, late=True)))


def _history(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    facts = _facts_of(order_log(spark, sf_dir, late=late))
    candidates = entities.organizer_candidates(facts, entities.bookings(facts))
    return entities.organizer_history(materialize(candidates, "candidates"))


def _read_chat(facts: DataFrame) -> DataFrame:
    people = materialize(entities.participants(facts), "participants")
    chat = materialize(P.chat_events(facts, people), "chat")
    return P.apply_reads(chat, materialize(P.chat_reads(facts, people), "reads"))


HISTORY = ["booking_id", "organizer", "source_event_id", "effective_from"]


@query
def organizer_history(spark, sf_dir):
    """WIN2, PRJ10"""
    return _history(spark, sf_dir).select(*HISTORY)


@query
def organizer_history_late(spark, sf_dir):
    """WIN2 with times out of order"""
    return _history(spark, sf_dir, late=True).select(*HISTORY)


@query
def latest_organizer(spark, sf_dir):
    """TOP1, TOP2"""
    return entities.latest_organizer(_history(spark, sf_dir, late=True))


@query
def organizer_periods(spark, sf_dir):
    """RD4"""
    return entities.organizer_periods(materialize(_history(spark, sf_dir), "history")).select(*HISTORY, "effective_to")


# --- projections from events ---


@query
def meeting_links(spark, sf_dir):
    """PRJ1, AGG7, FLT5"""
    return P.meeting_links(_facts(spark, sf_dir))


@query
def telegram_notifications(spark, sf_dir):
    """PRJ3, AGG8, JON3"""
    facts = _facts(spark, sf_dir)
    return P.telegram_notifications(facts, entities.participants(facts))


@query
def video_events(spark, sf_dir):
    """PRJ7"""
    return P.video_events(_facts(spark, sf_dir)).drop("payload", "received_at")


@query
def event_chat(spark, sf_dir):
    """PRJ5, PRJ6, JON3, JON5 over events of many bookings"""
    return _read_chat(_facts(spark, sf_dir, *PEOPLE, *CHAT)).select(
        "raw_event_id", "booking_id", "provider", "chat_event_type", "message_id", "participant", "is_read", "occurred_at"
    )


@query
def event_bookings_table(spark, sf_dir):
    """PRJ9 after deduplication"""
    return entities.bookings(_facts(spark, sf_dir, *BOOKINGS))


@query
def custom_projection(spark, sf_dir):
    """UDF1: a user's own table, run by the registry"""
    registry = Registry()
    registry.register(
        Projection(
            "reschedules",
            F.col("event_type") == "booking.rescheduled",
            lambda events, context: events.groupBy("booking_id").agg(F.count("*").alias("times")).join(
                context.bookings.select("booking_id", "current_status"), "booking_id"
            ),
            ("booking_id",),
        )
    )
    log = _stored(spark, sf_dir)
    facts = _facts_of(log)
    return pipeline.build_tables(log, facts, registry, persist=False)["reschedules"]


# --- projections from orders, lineitem and conversations ---


def _mails(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    facts = _facts_of(mail_log(spark, sf_dir), *PEOPLE, *MAILS)
    return P.email_notifications(facts, entities.participants(facts), **options)


@query
def email_notifications(spark, sf_dir):
    """PRJ2, AGG6, JON1, JON3, JON4"""
    return _mails(spark, sf_dir)


@query
def email_notifications_by_time(spark, sf_dir):
    """AGG6 with event time before arrival"""
    return _mails(spark, sf_dir, order="event_time").select("job_id", "last_status", "last_status_event_time", "last_status_event_id")


@query
def email_status_history(spark, sf_dir):
    """PRJ4, AGG9"""
    return P.email_status_history(_facts_of(mail_log(spark, sf_dir), *STATUSES))


@query
def email_status_events(spark, sf_dir):
    """PRJ4 with one row per status event"""
    return P.email_status_history(_facts_of(mail_log(spark, sf_dir), *STATUSES), grain="event")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_chat(_facts_of(conversation_log(spark, sf_dir)))


@query
def chat_events(spark, sf_dir):
    """PRJ5"""
    facts = _facts_of(conversation_log(spark, sf_dir))
    return P.chat_events(facts, entities.participants(facts)).drop("received_at")


@query
def chat_read_state(spark, sf_dir):
    """PRJ6, JON5"""
    return _conversations(spark, sf_dir).select("raw_event_id", "booking_id", "participant", "is_read")


# --- read operators ---


@query
def timeline_topk(spark, sf_dir):
    """RD1"""
    return readers.timeline_top(raw_events(spark, sf_dir), 3).select("booking_id", "rank", "event_id", "occurred_at")


@query
def booking_timeline(spark, sf_dir):
    """RD1 for one booking"""
    return readers.booking_timeline(laid_out(raw_events, spark, sf_dir), "b7").select("event_id", "event_type", "occurred_at")


@query
def events_by_type(spark, sf_dir):
    """RD2"""
    return readers.events_of_type(laid_out(raw_events, spark, sf_dir), S.BOOKING_CREATED, 100).select("event_id", "booking_id", "occurred_at")


@query
def recent_bookings(spark, sf_dir):
    """RD3"""
    table_ = entities.bookings(_facts_of(order_log(spark, sf_dir)))
    return readers.recent_bookings(table_, 20).select("booking_id", "last_seen_at", "current_status")


@query
def history_of_booking(spark, sf_dir):
    """RD4 for one booking"""
    periods = entities.organizer_periods(materialize(_history(spark, sf_dir), "history"))
    return readers.organizer_history_of(periods, "b5").select(*HISTORY, "effective_to")


@query
def links_of_bookings(spark, sf_dir):
    """RD5, JON2"""
    facts = _facts(spark, sf_dir, *LINKS, *BOOKINGS)
    return readers.links_with_bookings(P.meeting_links(facts), entities.bookings(facts)).select(
        "booking_id", "participant", "meeting_url", "source_event_id", "first_seen_at", "last_seen_at", "current_status"
    )


@query
def emails_of_booking(spark, sf_dir):
    """RD6"""
    return readers.emails_of(_mails(spark, sf_dir), "b5").select("job_id", "sent_at", "last_status")


@query
def emails_by_status_time(spark, sf_dir):
    """RD6 by status"""
    return readers.emails_by_status_time(_mails(spark, sf_dir), "O1").select("job_id", "last_status_event_time")


@query
def telegrams_of_booking(spark, sf_dir):
    """RD7"""
    facts = _facts(spark, sf_dir)
    return readers.telegrams_of(P.telegram_notifications(facts, entities.participants(facts)), "b7").select("sent_event_id", "participant", "sent_at")


@query
def emails_with_history(spark, sf_dir):
    """RD8"""
    facts = _facts_of(mail_log(spark, sf_dir), *PEOPLE, *MAILS)
    emails = P.email_notifications(facts, entities.participants(facts))
    return readers.emails_with_history(emails, P.email_status_history(facts)).select(
        "job_id", "booking_id", "status", "status_event_time", "source_event_id"
    )


@query
def chat_of_booking(spark, sf_dir):
    """RD9"""
    return readers.chat_of(_conversations(spark, sf_dir), "b3", "message.new").select("raw_event_id", "participant", "is_read", "occurred_at")


@query
def video_of_booking(spark, sf_dir):
    """RD10"""
    return readers.video_of(P.video_events(_facts(spark, sf_dir)), "b7", "audioMuteStatusChanged").select("raw_event_id", "event_time")


@query
def role_counts(spark, sf_dir):
    """RD11"""
    return readers.role_counts(entities.participants(_facts_of(order_log(spark, sf_dir))))


@query
def organizers(spark, sf_dir):
    """RD11 for one role"""
    people = entities.participants(_facts_of(order_log(spark, sf_dir)))
    return readers.participants_of_role(people, S.ROLE_CLIENT).select("email", "time_zone")


@query
def trace_lookup(spark, sf_dir):
    """RD12"""
    return readers.events_of_trace(laid_out(raw_events, spark, sf_dir), "t42").select("event_id", "event_type", "occurred_at")


@query
def latest_event_per_booking(spark, sf_dir):
    """TOP1 over the log"""
    rows = raw_events(spark, sf_dir).filter(F.col("booking_id").isNotNull()).select("booking_id", "event_id", "event_type", "occurred_at")
    return readers.latest_per(rows, "booking_id", "occurred_at", "event_id")


# --- checks and metrics ---


@query
def orphans(spark, sf_dir):
    """REF1: orders, items and labels whose parent is missing"""
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "part", "supplier", "documents", "labels", "events")}
    references = [
        integrity.Reference("orders", "o_custkey", "customer", "c_custkey"),
        integrity.Reference("lineitem", "l_orderkey", "orders", "o_orderkey"),
        integrity.Reference("lineitem", "l_partkey", "supplier", "s_suppkey"),
        integrity.Reference("labels", "doc_id", "documents", "doc_id"),
        integrity.Reference("documents", "doc_id", "labels", "doc_id"),
        integrity.Reference("events", "user_id", "supplier", "s_suppkey"),
    ]
    return integrity.orphan_report(tables, references)


@query
def pipeline_orphans(spark, sf_dir):
    """REF1: what the chat and video tables of a whole log refer to and a log cut half way would lack"""
    log = _stored(spark, sf_dir)
    facts, border = _facts_of(log), F.lit("2024-01-16 00:00:00").cast("timestamp")
    early = facts.filter(F.col("received_at") < border)
    people = entities.participants(facts)
    tables = {
        "events": log.filter(F.col("received_at") < border),
        "bookings": entities.bookings(early),
        "participants": entities.participants(early),
        "chat_events": P.chat_events(facts, people),
        "video_events": P.video_events(facts),
    }
    return integrity.orphan_report(tables)


@query
def event_metrics(spark, sf_dir):
    """DOC7"""
    return quality.event_metrics(raw_events(spark, sf_dir))


@query
def event_priority(spark, sf_dir):
    """DOC4"""
    return raw_events(spark, sf_dir).groupBy(quality.priority(F.col("event_type")).alias("priority")).agg(F.count("*").alias("events"))


@query
def contract_violations(spark, sf_dir):
    """DOC5"""
    return quality.contract_violations(event_log(spark, sf_dir)).groupBy("event_type", "field", "problem").agg(F.count("*").alias("events"))


@query
def contract_by_rules(spark, sf_dir):
    """DOC5: whole payloads of six types, both shapes of a mail, against the table of rules"""
    n, k = F.col("n"), F.col("k")
    kinds = ["notification.email.message_sent", S.EMAIL_SENT, S.BOOKING_CREATED, S.TELEGRAM_SENT, "booking.rescheduled", "chat.deleted"]
    at, unless = iso("received_at"), lambda part, value: F.when(k % part != 0, value)
    booking = F.lit("b").alias("booking_uid")
    person = F.struct(F.lit("a@x.org").alias("email"), unless(4, "UTC").alias("time_zone"))
    payloads = [
        F.struct(
            booking, unless(5, "a@x.org").alias("email"), F.lit("X").alias("trigger_event"), F.lit(None).cast("string").alias("job_id"),
            F.when(k % 3 == 0, "guest").otherwise("client").alias("recipient_role"),
        ),
        F.struct(
            booking, F.lit("a@x.org").alias("client_email"), F.when(k % 4 == 0, "soon").otherwise(at).alias("available_from"),
            unless(3, F.lit(True)).alias("has_active_booking"), F.lit(5).alias("job_id"), F.lit("BOOKING_REJECTED").alias("trigger_event"),
            F.array(at, F.when(k % 5 == 0, "x").otherwise(at)).alias("previous_meeting_dates"), F.array().cast("array<string>").alias("rejection_reasons"),
        ),
        F.struct(booking, person.alias("user"), unless(5, person).alias("client"), at.alias("start_time"), F.lit("2026-02-30").alias("end_time")),
        F.struct(booking, F.lit("a@x.org").alias("email"), F.lit("X").alias("trigger_event"), F.when(k % 2 == 0, "client").otherwise("organizer").alias("recipient_role")),
        F.struct(booking, at.alias("start_time"), at.alias("end_time"), F.struct(F.when(k % 3 != 0, "soon").alias("start_time")).alias("previous_booking")),
        F.struct(unless(4, "b").alias("booking_uid")),
    ]
    chain, texts = F, F
    for i, (kind, payload) in enumerate(zip(kinds, payloads)):
        chain, texts = chain.when(n % 6 == i, kind), texts.when(n % 6 == i, F.to_json(payload))
    log = raw_events(spark, sf_dir).withColumns({"event_type": chain, "payload_json": texts})
    return contract.contract_problems(log, contract.default_rules(spark))


@query
def idempotency_keys(spark, sf_dir):
    """DOC1"""
    return raw_events(spark, sf_dir).select(
        "event_id", hashing.idempotency_key(F.col("event_type"), F.col("booking_id"), F.col("props")).alias("key")
    )


@query
def replay_window(spark, sf_dir):
    """DOC6: bookings rebuilt from a period of the log"""
    log = event_log(spark, sf_dir)
    return pipeline.replay(log, "2024-01-10 00:00:00", "2024-01-20 00:00:00", persist=False)["bookings"]


@query
def normalize_payloads(spark, sf_dir):
    """DOC8: participants and booking data of raw payloads"""
    raw = raw_events(spark, sf_dir).withColumn(
        "payload_json",
        F.to_json(
            F.struct(
                F.struct(F.concat(F.lit("o"), (F.col("k") % 5).cast("string")).alias("email"), F.lit("UTC").alias("time_zone")).alias("user"),
                F.when(F.col("k") % 2 == 0, F.struct(F.concat(F.lit("c"), "user_id").alias("email"))).alias("client"),
                F.struct(F.concat(F.lit("d"), "user_id").alias("email")).alias("event_data"),
            )
        ),
    )
    normalized = N.normalize(raw.filter(F.col("source") != "getstream").select(*S.ENVELOPE_COLUMNS))
    facts = _facts_of(normalized)
    return entities.participant_rows(facts).select("event_id", "pos", "email", "role", "time_zone")


@query
def normalize_whole(spark, sf_dir):
    """DOC8 over all events, chat with its encoded ids too: participants, times and status"""
    n, k, chat = F.col("n"), F.col("k"), F.col("source") == S.SOURCE_CHAT
    raw = raw_events(spark, sf_dir).withColumn(
        "event_type", F.when((F.col("event_type") == "booking.rescheduled") & (n % 2 == 0), S.BOOKING_CANCELLED).otherwise(F.col("event_type"))
    )
    name = F.concat(F.lit("g"), "user_id")
    # sealed, sealed with another secret, not sealed, missing
    chat_id = F.when(n % 6 < 3, hashing.encode_user_id(name, "a secret")).when(n % 6 == 3, hashing.encode_user_id(name, "wrong")).when(n % 6 == 4, name)
    listed = F.array(
        F.struct(F.concat(F.lit("u"), "user_id").alias("email"), F.lit("client").alias("role")),
        F.struct(F.lit(None).cast("string").alias("email"), F.lit("organizer").alias("role")),
    )
    user = F.struct(F.concat(F.lit("o"), (k % 5).cast("string")).alias("email"), F.lit("UTC").alias("time_zone"), F.when(chat, chat_id).alias("id"))
    payload = F.struct(
        user.alias("user"),
        F.when(k % 2 == 0, F.struct(F.concat(F.lit("c"), "user_id").alias("email"))).alias("client"),
        F.when(n % 7 == 0, listed).alias("users"),
        F.struct(F.concat(F.lit("d"), "user_id").alias("email")).alias("event_data"),
        F.when(n % 4 != 0, iso("received_at")).alias("start_time"),
        F.when(n % 5 != 0, iso("occurred_at")).alias("end_time"),
    )
    normalized = N.normalize(raw.withColumn("payload_json", F.to_json(payload)).select(*S.ENVELOPE_COLUMNS), "a secret")
    facts = _facts_of(normalized, "event_id", "start_time", "end_time", "booking_status", "participants")
    people = facts.select("event_id", "start_time", "end_time", F.col("booking_status").alias("status"), F.posexplode_outer("participants").alias("pos", "p"))
    return people.select("event_id", "start_time", "end_time", "status", "pos", "p.*")


# --- functions ---


@query
def payload_hashes(spark, sf_dir):
    """HSH1, HSH2 over whole document texts: as text, compact and canonical"""
    text = F.to_json(F.struct("source", "lang"))
    loose = F.concat(F.lit('{ "source" : '), F.to_json(F.struct("source")).substr(F.lit(11), F.length(F.to_json(F.struct("source"))) - 11), F.lit(' , "lang": "'), F.col("lang"), F.lit('" }'))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5("text").alias("text_hash"),
        (hashing.payload_hash(loose, "compact") == F.md5(text)).alias("compact_equal"),
        hashing.payload_hash(loose, "canonical").alias("canonical_hash"),
    )


@query
def live_hashes(spark, sf_dir):
    """HSH1, SRC5: one payload written with blanks, escapes and other reals, or an empty body, has one hash"""
    escape = lambda c: F.array_join(F.transform(F.split(c, ""), lambda x: F.concat(F.lit("\\u00"), F.hex(F.ascii(x)))), "")
    n, k, user = F.col("n"), F.col("k"), F.col("user_id").cast("string")
    part = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    body = (
        F.when(n % 5 == 0, part('{"k":', k, ',"url":"https://x.org/', user, '","name":"é ', F.col("base"), '","at":', (k / 4).cast("string"), "}"))
        .when(n % 5 == 1, part('{ "k" : ', k, ',\n "url": "https:\\/\\/x.org\\/', user, '", "name" :"\\u00E9 ', F.col("base"), '" , "at": ', k * 25, "e-2 }\t"))
        .when(n % 5 == 2, part('{"\\u006b":', k, ',"url":"https:\\u002F/x.org/', user, '","name":"\\u00e9\\u0020', escape(F.col("base")), '","at":', (k / 4).cast("string"), "00}"))
        .when(n % 5 == 3, part(" {", F.when(k % 2 == 0, " ").otherwise("\n"), "} "))
        .otherwise(F.when(k % 2 == 0, " 0.0 ").otherwise("[ ]"))
    )
    headers = {"ce-id": F.col("event_id"), "ce-type": F.col("event_type"), "ce-source": F.col("source"), "ce-time": iso("occurred_at")}
    pairs = [x for name, value in headers.items() for x in (F.lit(name), value)]
    messages = raw_events(spark, sf_dir).select(F.create_map(*pairs).alias("headers"), body.alias("body"), "queue", "received_at")
    return M.valid_envelopes(M.decode_messages(messages)).select("event_id", "payload_hash")


@query
def text_previews(spark, sf_dir):
    """STR2, EXT8: previews of whole documents through a JSON payload"""
    doc = J.parse(F.to_json(F.struct(F.struct("text").alias("message"))))
    return table(spark, sf_dir, "documents").select("doc_id", extract.text_preview(doc).alias("preview"))


@query
def user_id_decode(spark, sf_dir):
    """COD1: names sealed and opened again; other texts stay as they are"""
    sealed = hashing.encode_user_id(F.col("c_name"), "a secret")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        hashing.decode_user_id(sealed, "a secret").alias("opened"),
        (hashing.decode_user_id(sealed, "wrong") == sealed).alias("wrong_secret_keeps"),
        hashing.decode_user_id(F.col("c_mktsegment"), "a secret").alias("plain"),
    )


@query
def iso_times(spark, sf_dir):
    """TIM1, TIM2: one time in many spellings"""
    ts = F.col("ts").cast("timestamp")
    form = F.col("event_id") % 6
    spelled = (
        F.when(form == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(form == 1, F.date_format(ts, "yyyyMMdd'T'HHmmss"))
        .when(form == 2, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("+03:00")))
        .when(form == 3, F.date_format(ts, "yyyy-MM-dd"))
        .when(form == 4, F.date_format(ts, "yyyy"))
        .otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("999Z")))
    )
    return table(spark, sf_dir, "events").select("event_id", times.iso_timestamp(spelled).alias("at"))


# --- streaming and the whole plan ---


@query
def stream_log(spark, sf_dir):
    """SRC1, SNK1, SNK3, SNK4, STM1-5: the log built by a stream from two arrivals of messages"""
    messages = event_headers(spark, sf_dir).select(*MESSAGE_SCHEMA.fieldNames())
    inbox, checkpoint = fresh_path(spark, "inbox"), fresh_path(spark, "stream")
    ingest = StreamIngest(spark, fresh_path(spark, "store"), hash_mode="text")
    early = F.col("received_at") < F.lit("2024-01-16 00:00:00").cast("timestamp")
    for part in (early, ~early):
        messages.filter(part).write.mode("append").parquet(inbox)
        ingest.start(M.stream_messages(spark, inbox), checkpoint, availableNow=True).awaitTermination()
    return ingest.table("events").select(*ID, "occurred_at", "received_at", "payload_hash", "idempotency_key")


def _messages(log: DataFrame) -> DataFrame:
    """Envelopes as broker messages, each with its id as key."""
    headers = {"ce-id": F.col("event_id"), "ce-type": F.col("event_type"), "ce-source": F.col("source"), "ce-time": iso("occurred_at")}
    headers |= {"ce-booking_id": F.col("booking_id"), "ce-idempotencykey": F.col("event_id")}
    names = F.array(*[F.lit(h) for h in headers])
    return log.select(F.map_from_arrays(names, F.array(*headers.values())).alias("headers"), F.col("payload_json").alias("body"), "queue", "received_at")


def _streamed(
    spark: SparkSession, log: DataFrame, withheld: Column, name: str, at_once: Column | None = None, registry: Registry | None = None
) -> StateTable:
    """A table kept as state by streams, over three arrivals of the whole log.

    The first half by id (and what comes ``at_once``) is first, then the other half with a
    part of the first again; rows that are ``withheld`` come last of all, after rows that were
    received later.
    """
    number, at_once = F.pmod(F.xxhash64("event_id"), F.lit(10)), F.lit(False) if at_once is None else at_once
    first, second = ~withheld & (at_once | (number < 5)), ~withheld & ~at_once & (number >= 5)
    arrivals = [first, second | (~withheld & (number == 2)), withheld | (number == 7)]
    inbox, checkpoint, state_checkpoint = fresh_path(spark, "inbox"), fresh_path(spark, "stream"), fresh_path(spark, "state")
    ingest = StreamIngest(spark, fresh_path(spark, "store"), hash_mode="text", registry=registry)
    state = StateTable(spark, registry.folded[name].fold if registry else FOLDS[name](), ingest.store, name)
    for part in arrivals:
        _messages(log.filter(part)).write.mode("append").options(**PACKED).parquet(inbox)
        ingest.start(M.stream_messages(spark, inbox, consume=True), checkpoint, availableNow=True).awaitTermination()
        state.start(state_checkpoint, availableNow=True).awaitTermination()
    return state


@query
def stream_bookings(spark, sf_dir):
    """STM1-5, PRJ9: bookings as stream state, with late and repeated messages"""
    return _streamed(spark, order_log(spark, sf_dir, late=True), F.pmod(F.xxhash64("event_id"), F.lit(7)) == 3, "bookings").table()


@query
def stream_custom(spark, sf_dir):
    """UDF1, STM1-5: a user's own fold as stream state, with late and repeated messages"""
    registry = Registry()
    fold = Fold(
        ["booking_id"],
        {"first_event_id": first(F.col("event_id")), "last_event_id": latest(F.col("event_id")), "latest_at": greatest(F.col("occurred_at"))},
    )
    registry.register(FoldedProjection("reassignments", F.col("event_type") == S.BOOKING_REASSIGNED, fold))
    withheld = F.pmod(F.xxhash64("event_id"), F.lit(7)) == 3
    return _streamed(spark, order_log(spark, sf_dir, late=True), withheld, "custom_reassignments", registry=registry).table()


@query
def stream_emails(spark, sf_dir):
    """STM1-5, PRJ2: mails as stream state; statuses come late and twice

    Sent mails come first, as they name the participants that a status is looked up among.
    """
    late = (F.col("event_type") == S.MAIL_STATUS) & (F.pmod(F.xxhash64("event_id"), F.lit(7)) == 3)
    return _streamed(spark, mail_log(spark, sf_dir), late, "email_notifications", F.col("event_type") == S.EMAIL_SENT).table()


@query
def stream_participant_changes(spark, sf_dir):
    """AGG2: the feed of changed participants, replayed"""
    state = _streamed(spark, order_log(spark, sf_dir), F.pmod(F.xxhash64("event_id"), F.lit(7)) == 3, "participants")
    fold = state.fold
    changes = state.changes().groupBy("email").agg(F.max_by(F.struct(*fold.columns), "change").alias("last"))
    replayed = fold.result(changes.select("email", *[F.col(f"last.{n}").alias(n) for n in fold.columns]))
    return replayed.select("email", "role", "time_zone", F.col("first_seq")["event_id"].alias("first_event_id"))


@query
def pipeline_counts(spark, sf_dir):
    """PIPE, PRJ11: rows of every table of one run"""
    result = pipeline.run(event_log(spark, sf_dir))
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, t in result.tables.items()]
    total = counts[0]
    for part in counts[1:]:
        total = total.unionByName(part)
    return total
