"""Organizer history and read state against brute force on dense random input."""

import random
from datetime import datetime, timedelta

import pytest

from meetledger.operators.entities import latest_organizer, organizer_history, organizer_periods
from meetledger.operators.projections import apply_reads
from meetledger.operators.scan import running_max
from pyspark.sql import functions as F

T0 = datetime(2026, 1, 1)


def in_order(seed, size, disorder, organizers=3, bookings=3):
    rng = random.Random(seed)
    rows = []
    for n in range(size):
        received = T0 + timedelta(seconds=30 * n)
        occurred = received - timedelta(seconds=rng.randrange(0, disorder + 1) * 30)
        # one booking holds most rows
        booking = "b0" if rng.random() < 0.6 else f"b{rng.randrange(bookings)}"
        organizer = f"o{rng.randrange(organizers)}" if rng.random() < 0.4 or not rows else rows[-1][1]
        rows.append((booking, organizer, f"e{n:05d}", occurred, received))
    return rows


def history_one_by_one(rows):
    entries = []
    for booking, organizer, event, occurred, _ in rows:
        mine = [(x[3], i, x[1]) for i, x in enumerate(entries) if x[0] == booking]
        if not mine or max(mine)[2] != organizer:
            entries.append((booking, organizer, event, occurred))
    return entries


@pytest.mark.parametrize("seed,disorder,organizers", [(1, 0, 3), (2, 3, 3), (3, 40, 2), (4, 400, 3), (5, 5, 1), (6, 0, 1)])
def test_organizer_history(spark, seed, disorder, organizers):
    rows = in_order(seed, 700, disorder, organizers)
    random.Random(seed).shuffle(shuffled := list(rows))
    candidates = spark.createDataFrame(shuffled, "booking_id string, organizer string, event_id string, occurred_at timestamp, received_at timestamp")
    got = organizer_history(candidates, chunk="hour")
    expected = history_one_by_one(rows)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(expected)

    newest = {}
    for i, (booking, organizer, _, at) in enumerate(expected):
        newest[booking] = max(newest.get(booking, (at, i, organizer)), (at, i, organizer))
    assert {r["booking_id"]: r["organizer"] for r in latest_organizer(got).collect()} == {k: v[2] for k, v in newest.items()}
    ends = organizer_periods(got).groupBy("booking_id").agg(F.count_if(F.col("effective_to").isNull()).alias("open")).collect()
    assert all(r["open"] == 1 for r in ends)


def reads_one_by_one(messages, reads):
    marked = set()
    for m in messages:
        for r in reads:
            if m["booking_id"] != r["booking_id"] or m["chat_event_type"] != "message.new" or m["participant"] is None:
                continue
            if m["participant"] == r["reader"] or m["received_at"] > r["received_at"]:
                continue
            if (m["message_id"] is not None and m["message_id"] == r["last_read_message_id"]) or m["occurred_at"] < r["occurred_at"]:
                marked.add(m["raw_event_id"])
    return marked


@pytest.mark.parametrize("seed,people,lag", [(1, 2, 10), (2, 3, 2000), (3, 6, 200), (4, 1, 50)])
def test_apply_reads(spark, seed, people, lag):
    rng = random.Random(seed)
    messages, reads = [], []
    for n in range(1500):
        received = T0 + timedelta(seconds=20 * n)
        occurred = received - timedelta(seconds=rng.randrange(0, lag * 20))
        booking = "b0" if rng.random() < 0.7 else f"b{rng.randrange(4)}"
        if rng.random() < 0.93:
            messages.append(
                dict(
                    booking_id=booking,
                    raw_event_id=f"e{n:05d}",
                    provider="getstream",
                    chat_event_type=rng.choice(["message.new"] * 4 + ["message.read"]),
                    message_id=rng.choice([None, f"m{rng.randrange(400)}"]),
                    participant=rng.choice([None] + [f"p{i}" for i in range(people)] * 2),
                    text_preview=None,
                    occurred_at=occurred,
                    received_at=received,
                )
            )
        else:
            reads.append(
                dict(
                    booking_id=booking,
                    last_read_message_id=rng.choice([None, f"m{rng.randrange(400)}"]),
                    event_id=f"e{n:05d}",
                    # most reads look far back, so that the rule by id matters too
                    occurred_at=occurred - timedelta(days=rng.choice([0, 3, 3, 3])),
                    received_at=received,
                    reader=f"p{rng.randrange(people)}",
                )
            )
    chat = spark.createDataFrame(
        messages,
        "booking_id string, raw_event_id string, provider string, chat_event_type string, message_id string, participant string, "
        "text_preview string, occurred_at timestamp, received_at timestamp",
    )
    seen = spark.createDataFrame(
        reads,
        "booking_id string, last_read_message_id string, event_id string, occurred_at timestamp, received_at timestamp, reader string",
    )
    got = apply_reads(chat, seen, chunk="hour")
    assert got.count() == len(messages)
    assert {r["raw_event_id"] for r in got.filter("is_read").collect()} == reads_one_by_one(messages, reads)


@pytest.mark.parametrize("descending", [False, True])
def test_running_max_equals_a_plain_window(spark, descending):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), n, rng.choice([None, rng.randrange(1000)])) for n in range(800)]
    df = spark.createDataFrame(rows, "k string, n int, v int")
    df = df.withColumn("piece", F.floor(F.col("n") / 50))
    got = running_max(df, ["k"], ["n"], "piece", before={"lo": F.col("v")}, upto={"hi": F.col("v")}, descending=descending)
    expected = {}
    best = {}
    for k, n, v in sorted(rows, key=lambda r: r[1], reverse=descending):
        before = best.get(k)
        if v is not None and (before is None or v > before):
            best[k] = v
        expected[n] = (before, best.get(k))
    assert {r["n"]: (r["lo"], r["hi"]) for r in got.collect()} == expected
