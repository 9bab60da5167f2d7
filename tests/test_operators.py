"""Sources, sinks and smaller operators."""

from datetime import datetime

from meetledger import schemas as S
from meetledger.operators import dedup, entities, integrity, quality, readers
from meetledger.plans import normalize, pipeline
from meetledger.plans.registry import Projection, Registry
from meetledger.session import fresh_path
from meetledger.sources.csv_log import csv_envelopes, read_csv_log
from meetledger.sources.messages import decode_messages, kafka_messages, read_messages, valid_envelopes
from meetledger.sources.publish import kafka_records, outgoing_messages, write_messages
from pyspark.sql import functions as F

NOW = datetime(2026, 1, 1)


def log(spark, rows):
    """Envelopes from (id, booking, type, source, payload, key, second)."""
    full = [
        (i, b, t, s, NOW, NOW.replace(minute=n // 60, second=n % 60), "q", p, None, k, None, None, None) for i, b, t, s, p, k, n in rows
    ]
    return spark.createDataFrame(full, S.ENVELOPE_SCHEMA).withColumn("payload_hash", F.md5("payload_json"))


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def test_dedup_rules(spark):
    rows = log(
        spark,
        [
            ("a", "b1", "t", "s", "{}", None, 1),
            ("b", "b1", "t", "s", "{}", None, 2),  # same content
            ("c", None, "t", "s", "{}", None, 3),
            ("d", None, "t", "s", "{}", None, 4),  # no booking: both stay
            ("e", "b2", "t", "s", "{}", "k", 5),
            ("f", "b3", "t", "s", "{}", "k", 6),  # same key
            ("g", "b2", "t", "s", "{}", None, 7),  # content of a keyed row
            ("h", "b2", "t", "s", "{}", "k2", 8),  # a new key, though the content is known
            ("i", "b4", "t", "s", "{}", None, 9),
            ("j", "b4", "t", "s", "{}", "k3", 10),  # keyed after keyless
            ("k", "b5", "t", "s", "{}", "", 11),
            ("l", "b5", "t", "s", "{}", "", 12),  # an empty key is no key
        ],
    )
    assert ids(dedup.deduplicate(rows)) == ["a", "c", "d", "e", "h", "i", "j", "k"]
    assert ids(dedup.deduplicate(rows, legacy_scope="unkeyed")) == ["a", "c", "d", "e", "g", "h", "i", "j", "k"]
    assert ids(dedup.dedup_by_content(rows)) == ["a", "c", "d", "e", "f", "i", "k"]
    assert ids(dedup.dedup_history(rows)) == ["a", "c", "e", "f", "i", "k"]
    # in two runs
    stored = dedup.deduplicate(rows.filter("event_id <= 'e'"))
    fresh = dedup.drop_stored(rows.filter("event_id > 'e'"), stored)
    assert ids(dedup.deduplicate(fresh)) == ["h", "i", "j", "k"]


def test_copies_are_cut_before_the_shuffle(spark):
    plan = dedup.deduplicate(log(spark, [("a", "b", "t", "s", "{}", None, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_csv_log(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        "event_id,booking_id,event_type,source,payload,hash\n"
        f'e1,b1,{S.BOOKING_CREATED},booking,"{{""users"": [{{""role"": ""organizer"", ""email"": ""o@x.org""}}, {{""role"": ""client"", ""email"": ""c@x.org""}}], ""start_time"": ""2026-03-09T06:00:00+00:00""}}",h\n'
        f'e2,b1,{S.EMAIL_SENT},booking,"{{""users"": [{{""role"": ""client"", ""email"": ""c@x.org""}}], ""job_id"": ""j1"", ""trigger_event"": ""BOOKING_CREATED""}}",h\n'
        f'e3,b1,{S.MAIL_STATUS},unisender-go,"{{""event_data"": {{""email"": ""c@x.org"", ""job_id"": ""j1"", ""status"": ""sent"",\n""event_time"": ""2026-03-08 21:50:48""}}}}",h\n'
        f'e4,b1,{S.CHAT_MESSAGE_NEW},getstream,"{{""type"": ""message.new"", ""message"": {{""id"": ""m1"", ""text"": ""hi""}}, ""user"": {{""id"": ""c@x.org""}}}}",h\n'
    )
    envelopes = csv_envelopes(read_csv_log(spark, str(path)))
    assert [r["queue"] for r in envelopes.orderBy("event_id").collect()] == [
        "events.booking.lifecycle",
        "events.notification.delivery",
        "events.mail",
        "events.chat",
    ]
    raw = pipeline.run(envelopes, persist=False)
    assert raw["participants"].count() == 0  # raw payloads carry no normalized part
    mail = raw["email_notifications"].first()
    assert (mail["job_id"], mail["last_status"], mail["participant"]) == ("j1", "sent", None)

    full = pipeline.run(normalize.normalize(envelopes), persist=False)
    assert {(r["email"], r["role"]) for r in full["participants"].collect()} == {("o@x.org", "organizer"), ("c@x.org", "client")}
    booking = full["bookings"].first()
    assert (booking["organizer"], booking["client"], booking["current_status"], booking["start_time"]) == (
        "o@x.org", "c@x.org", "created", datetime(2026, 3, 9, 6),
    )
    assert full["email_notifications"].first()["participant"] == "c@x.org"
    chat = full["chat_events"].first()
    assert (chat["participant"], chat["text_preview"], chat["is_read"]) == ("c@x.org", "hi", None)


def test_published_messages_can_be_read_back(spark):
    rows = log(spark, [("a", "b1", S.BOOKING_CREATED, "booking", '{"x":1}', "k", 1), ("", None, "t", "s", None, None, 2)])
    out = outgoing_messages(rows)
    first, second = out.orderBy("message_type").collect()
    assert first["routing_key"] == "events.booking.lifecycle" and second["routing_key"] == "events.unrouted"
    assert first["headers"]["ce-id"] == "a" and len(second["headers"]["ce-id"]) == 36 and "ce-booking_id" not in second["headers"]

    path = fresh_path(spark, "published")
    write_messages(out, path)
    stored = spark.read.parquet(path).withColumn("queue", F.col("routing_key")).withColumn("received_at", F.lit(NOW))
    stored.select("headers", "body", "queue", "received_at").write.parquet(path + "-in")
    back = valid_envelopes(decode_messages(read_messages(spark, path + "-in", queues=["events.booking.lifecycle"])))
    row = back.first()
    assert back.count() == 1
    assert (row["event_id"], row["booking_id"], row["idempotency_key"], row["payload_json"], row["occurred_at"]) == ("a", "b1", "k", '{"x":1}', NOW)

    records = kafka_records(out).withColumn("timestamp", F.lit(NOW))
    through = kafka_messages(records)
    assert {r["headers"]["ce-type"] for r in through.collect()} == {S.BOOKING_CREATED, "t"}
    assert through.filter("queue = 'events.unrouted'").first()["body"] == "{}"


def test_unwrap_original(spark):
    messages = spark.createDataFrame(
        [({"ce-id": "1", "ce-type": "t", "ce-source": "s"}, '{"original": {"a": 1}, "normalized": {}}', "q", NOW)], S.MESSAGE_SCHEMA
    )
    assert valid_envelopes(decode_messages(messages, unwrap_original=True)).first()["payload_json"] == '{"a":1}'
    assert valid_envelopes(decode_messages(messages)).first()["payload_json"].startswith('{"original"')


def test_changed_and_merged_participants(spark):
    schema = "email string, role string, time_zone string"
    old = spark.createDataFrame([("a", "client", "UTC"), ("b", None, None), ("c", "client", None)], schema)
    new = spark.createDataFrame([("a", "client", None), ("b", None, None), ("c", "organizer", None), ("d", None, None)], schema)
    assert sorted(r["email"] for r in entities.changed_participants(new, old).collect()) == ["c", "d"]
    merged = {r["email"]: (r["role"], r["time_zone"]) for r in entities.merge_participants(old, new).collect()}
    assert merged == {"a": ("client", "UTC"), "b": (None, None), "c": ("organizer", None), "d": (None, None)}


def test_user_projection_runs_beside_the_others(spark):
    rows = log(spark, [("a", "b1", "x.new", "s", '{"n": 1}', None, 1), ("b", "b1", "x.new", "s", '{"n": 2}', None, 2)])
    registry = Registry()
    registry.register(Projection("xs", F.col("event_type") == "x.new", lambda events, context: events.groupBy("booking_id").count()))
    result = pipeline.run(rows, registry=registry)
    assert result["xs"].first()["count"] == 2
    try:
        registry.register(Projection("xs", F.lit(True), lambda e, c: e))
        raise AssertionError("a name can be used once")
    except ValueError:
        pass


def test_references_of_a_run_hold(spark):
    payload = '{"normalized": {"participants": [{"email": "o@x", "role": "organizer"}]}, "meeting_url": "u"}'
    rows = log(spark, [("a", "b1", S.BOOKING_CREATED, "booking", payload, None, 1), ("b", "b1", S.MEETING_URL_CREATED, "booking", payload, None, 2)])
    tables = pipeline.run(rows, persist=False).tables
    assert integrity.orphan_report(tables).count() == 0
    tables["participants"] = tables["participants"].filter("email <> 'o@x'")
    assert {(r["child"], r["column"]) for r in integrity.orphan_report(tables).collect()} == {
        ("bookings", "organizer"), ("organizer_history", "organizer"), ("meeting_links", "participant"),
    }


def test_readers_and_metrics(spark):
    rows = log(spark, [(c, f"b{n % 2}", "t" if n < 3 else "u", "s", "{}", f"k{n}", n) for n, c in enumerate("abcde")])
    assert [r["event_id"] for r in readers.booking_timeline(rows, "b0").collect()] == ["e", "c", "a"]
    assert [r["event_id"] for r in readers.events_of_type(rows, "t", 2).collect()] == ["c", "b"]
    assert readers.timeline_top(rows, 1).count() == 2
    assert {r["event_type"]: r["events"] for r in quality.event_metrics(rows).collect()} == {"t": 3, "u": 2}
    assert {r["booking_id"]: r["event_id"] for r in readers.latest_per(rows, "booking_id", "received_at", "event_id").collect()} == {"b0": "e", "b1": "d"}
