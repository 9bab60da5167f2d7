"""The batch plan and the one-by-one oracle build the same tables from random logs."""

import json

import pytest

from meetledger.functions.hashing import encode_user_id
from meetledger.plans import pipeline
from meetledger.schemas import MESSAGE_SCHEMA
from pyspark.sql import functions as F
from tests.messages import PEOPLE, random_log
from tests.one_by_one import Ledger

SECRET = "test secret"


@pytest.fixture(scope="session")
def codes(spark):
    rows = spark.createDataFrame([(p,) for p in PEOPLE], "email string").select("email", encode_user_id(F.col("email"), SECRET).alias("code"))
    return {r["email"]: r["code"] for r in rows.collect()}


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def expect(items):
    return sorted(items, key=repr)


def compare(result, ledger):
    t = result.tables
    assert rows(t["events"], "event_id") == expect([(k,) for k in ledger.events])
    assert rows(t["participants"], "email", "role", "time_zone") == expect(
        [(k, v["role"], v["time_zone"]) for k, v in ledger.people.items()]
    )
    fields = ["first_seen_at", "last_seen_at", "start_time", "end_time", "current_status", "organizer", "client"]
    assert rows(t["bookings"], "booking_id", *fields) == expect([(k, *[v[f] for f in fields]) for k, v in ledger.bookings.items()])
    assert rows(t["organizer_history"], "booking_id", "organizer", "source_event_id", "effective_from") == expect(
        [(h["booking"], h["organizer"], h["event"], h["from"]) for h in ledger.history]
    )
    assert rows(t["meeting_links"], "booking_id", "participant", "meeting_url", "source_event_id", "occurred_at") == expect(
        [(*k, v["meeting_url"], v["source_event_id"], v["occurred_at"]) for k, v in ledger.links.items()]
    )
    fields = list(next(iter(ledger.emails.values())))
    assert rows(t["email_notifications"], "job_id", *fields) == expect([(k, *[v[f] for f in fields]) for k, v in ledger.emails.items()])
    assert rows(t["email_status_history"], "job_id", "status", "status_event_time", "source_event_id") == expect(
        [(*k, v["status_event_time"], v["source_event_id"]) for k, v in ledger.statuses.items()]
    )
    assert rows(t["telegram_notifications"], "booking_id", "participant", "trigger_event", "sent_event_id", "sent_at") == expect(
        [(*k[:3], v["sent_event_id"], v["sent_at"]) for k, v in ledger.telegrams.items()]
    )
    fields = ["booking_id", "provider", "chat_event_type", "message_id", "participant", "is_read", "text_preview", "occurred_at"]
    assert rows(t["chat_events"], "raw_event_id", *fields) == expect([(k, *[v[f] for f in fields]) for k, v in ledger.chat.items()])
    fields = ["booking_id", "video_event_type", "participant_role", "participant", "event_time"]
    assert rows(t["video_events"], "raw_event_id", *fields) == expect([(k, *[v[f] for f in fields]) for k, v in ledger.video.items()])
    payloads = {r["raw_event_id"]: json.loads(r["payload"]) for r in t["video_events"].collect()}
    assert payloads == {k: v["payload"] for k, v in ledger.video.items()}


def replay_one_by_one(log, codes):
    ledger = Ledger(decode=lambda x: {v: k for k, v in codes.items()}.get(x, x))
    for message in log:
        ledger.receive(message)
    return ledger


@pytest.mark.parametrize("seed,size", [(1, 150), (2, 400), (3, 400)])
def test_random_logs(spark, codes, seed, size):
    log = random_log(seed, size, encode=codes.get)
    ledger = replay_one_by_one(log, codes)
    messages = spark.createDataFrame([(m["headers"], m["body"], m["queue"], m["received_at"]) for m in log], MESSAGE_SCHEMA)
    result = pipeline.run_messages(messages, secret=SECRET)
    compare(result, ledger)

    rejected = rows(result.rejects["messages"], "reject_reason", "event_id")
    conflicts = rows(result.rejects["event_id_conflicts"], "reject_reason", "event_id")
    assert expect(rejected + conflicts) == expect(ledger.rejects)
    names = {
        "meeting": "meeting_links",
        "email": "notifications",
        "telegram": "notifications",
        "chat_event": "chat_events",
        "chat_read": "chat_read_state",
        "video_event": "video_events",
    }
    assert rows(result.rejects["projections"], "projection", "event_id", "reject_reason") == expect(
        [(names[n], i, r) for n, i, r in ledger.failed]
    )
