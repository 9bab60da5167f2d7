"""Bucketed lookups, the key index, and tables kept as stream state."""

import random

import pytest
from pyspark.sql import functions as F

from meetledger.operators import entities
from meetledger.session import fresh_path
from meetledger.sources.key_index import KEY_COLUMNS, KeyIndex
from meetledger.sources.messages import stream_messages
from meetledger.sources.tables import LITERAL_KEYS, TableStore
from meetledger.schemas import MESSAGE_SCHEMA
from meetledger.streaming.ingest import FOLDS, StreamIngest
from meetledger.streaming.state import StateTable
from tests.messages import random_log


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def store_with_numbers(spark, n, buckets=16):
    store = TableStore(spark, fresh_path(spark, "store"), buckets)
    for part in range(2):
        commit = store.begin()
        rows = spark.range(part * n, (part + 1) * n).select(F.concat(F.lit("k"), "id").alias("key"), "id")
        commit.append("numbers", rows, bucket_by=["key"])
        commit.publish()
    return store


def test_lookup_by_value_names_its_buckets(spark):
    store = store_with_numbers(spark, 400)
    keys = spark.createDataFrame([("k5",), ("k500",), ("k500",), ("none",), (None,)], "key string")
    found = store.lookup("numbers", keys)
    assert sorted(r["id"] for r in found.collect()) == [5, 500]
    assert found.columns == ["key", "id"]
    plan = plan_of(found)
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [_bucket" in plan
    assert "PushedFilters: [In(key" in plan or "In(key" in plan
    assert len(found.inputFiles()) <= 2 * 16
    assert store.lookup("absent", keys) is None


def test_lookup_of_many_keys_prunes_at_run_time(spark):
    store = store_with_numbers(spark, 2_000)
    keys = store.read("numbers").select("key").filter(F.col("id") % 3 == 0)
    assert keys.count() > LITERAL_KEYS
    found = store.lookup("numbers", keys)
    assert sorted(r["id"] for r in found.collect()) == list(range(0, 4_000, 3))
    # a reader of the table itself sees every row, and no layout columns
    assert store.read("numbers").columns == ["key", "id"] and store.read("numbers").count() == 4_000
    narrow = store.lookup("numbers", keys.limit(LITERAL_KEYS + 100))
    assert "dynamicpruning" in plan_of(narrow) or narrow.count() == LITERAL_KEYS + 100


def test_filters_of_small_files_are_small(spark):
    import glob
    import os

    store = store_with_numbers(spark, 300, buckets=8)
    files = glob.glob(f"{store.root}/numbers/*/*/*.parquet")
    assert 8 <= len(files) <= 16 and max(map(os.path.getsize, files)) < 50_000


def test_layout_is_kept_by_later_commits(spark):
    store = store_with_numbers(spark, 50)
    commit = store.begin()
    commit.replace("numbers", store.read("numbers"))
    commit.publish()
    assert store.manifest()["tables"]["numbers"]["layout"] == {"keys": ["key"], "buckets": 16}
    assert store.lookup("numbers", spark.createDataFrame([("k7",)], "key string")).count() == 1


def log_rows(spark, rows):
    schema = "event_id string, idempotency_key string, booking_id string, event_type string, source string, payload_hash string, received_at timestamp"
    return spark.createDataFrame(rows, schema).select(*KEY_COLUMNS)


def test_index_finds_all_that_share_a_claim(spark):
    import datetime

    rng = random.Random(3)
    pick = lambda *values: rng.choice(values)
    rows = [
        (f"e{rng.randrange(150)}", pick(None, "", "k1", "k2", f"k{i}"), pick(None, "b1", "b2", f"b{i}"), pick("t", "u"), "s", pick("h1", "h2", f"h{i}"), datetime.datetime(2024, 1, 1 + i % 28, i % 24))
        for i in range(200)
    ]
    old, new = rows[:150], rows[150:]
    index = KeyIndex(TableStore(spark, fresh_path(spark, "store")))
    assert index.sharing(log_rows(spark, new)) is None
    commit = index.store.begin()
    index.add(commit, log_rows(spark, old))
    commit.publish()

    def claims(r):
        return {("i", r[0])} | ({("k", r[1])} if r[1] else set()) | ({("c", *r[2:6])} if r[2] is not None else set())

    wanted = set().union(*map(claims, new))
    got = sorted((r["event_id"], r["received_at"]) for r in index.sharing(log_rows(spark, new)).collect())
    assert got == sorted({(r[0], r[6]) for r in old if claims(r) & wanted})


@pytest.fixture(scope="module")
def ingested(spark):
    """Three batches, the last with late and repeated messages; tables as state after each."""
    messages = [(m["headers"], m["body"], m["queue"], m["received_at"]) for m in random_log(21, 240)]
    parts = [messages[:120], messages[120:], messages[30:60] + messages[130:150]]
    inbox, checkpoint = fresh_path(spark, "inbox"), fresh_path(spark, "stream")
    ingest = StreamIngest(spark, fresh_path(spark, "store"))
    states = {n: StateTable(spark, FOLDS[n](), ingest.store, n) for n in ("participants", "bookings", "email_notifications")}
    checkpoints = {n: fresh_path(spark, f"state-{n}") for n in states}
    history = []
    for part in parts:
        spark.createDataFrame(part, MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        ingest.start(stream_messages(spark, inbox), checkpoint, availableNow=True).awaitTermination()
        for name, state in states.items():
            state.start(checkpoints[name], availableNow=True).awaitTermination()
        history.append({n: set(map(repr, s.table().collect())) for n, s in states.items()})
    return ingest, states, checkpoints, history


def test_state_equals_the_merged_partials(spark, ingested):
    ingest, states, _, _ = ingested
    for name, state in states.items():
        expected = sorted(map(repr, ingest.table(name).collect()))
        assert expected and sorted(map(repr, state.table().collect())) == expected, name


def test_changes_hold_only_what_changed(spark, ingested):
    _, states, _, history = ingested
    for name, state in states.items():
        for number, (before, after) in enumerate(zip([set(), *[h[name] for h in history]], [h[name] for h in history])):
            changed = state.changes().filter(F.col("change") == number)
            rows = set(map(repr, state.fold.result(changed.drop("change")).collect()))
            # every new or differing row is among the changes, and every change is a current row
            assert after - before <= rows <= after, (name, number)
        total = state.changes().count()
        assert total < sum(len(h[name]) for h in history)


def test_repeated_partials_change_nothing(spark, ingested):
    ingest, states, checkpoints, _ = ingested
    before = {n: sorted(map(repr, s.table().collect())) for n, s in states.items()}
    counts = {n: s.changes().count() for n, s in states.items()}
    ingest.compact()  # its merged partials reach the state streams as new files
    for name, state in states.items():
        state.start(checkpoints[name], availableNow=True).awaitTermination()
        assert sorted(map(repr, state.table().collect())) == before[name]
        assert state.changes().count() == counts[name]


def test_rows_of_some_keys(spark, ingested):
    _, states, _, _ = ingested
    state = states["bookings"]
    keys = state.table().select("booking_id").limit(2)
    assert sorted(map(repr, state.rows_of(keys).collect())) == sorted(map(repr, state.table().join(keys, "booking_id", "left_semi").collect()))


def test_no_python_in_the_state(spark, ingested):
    ingest, states, _, _ = ingested
    plan = plan_of(states["bookings"].merged(ingest.store.read("bookings")))
    assert "Python" not in plan and "Pandas" not in plan
    assert entities.booking_fold().keys == ["booking_id"]
