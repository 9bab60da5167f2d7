"""What a stream leaves on disk: nothing it needed for a while only, and no row's columns twice."""

import glob
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meetledger.operators.dedup import _ORDER
from meetledger.schemas import MESSAGE_SCHEMA
from meetledger.session import STREAM_CONF, fresh_path, materialize, work_dir
from meetledger.sources.key_index import KEY_COLUMNS, KeyIndex
from meetledger.sources.messages import stream_messages
from meetledger.sources.tables import TableStore
from meetledger.streaming.ingest import FOLDS, StreamIngest
from meetledger.streaming.state import StateTable
from tests.messages import random_log
from tests.test_contested import listed, rows_of


def frame(spark, log):
    return spark.createDataFrame([(m["headers"], m["body"], m["queue"], m["received_at"]) for m in log], MESSAGE_SCHEMA).coalesce(1)


def folders(spark):
    return {d for d in glob.glob(f"{work_dir(spark)}/{spark.sparkContext.applicationId}/*")}


def parquet_files(root):
    return glob.glob(f"{root}/**/*.parquet", recursive=True)


@pytest.fixture(scope="module")
def streamed(spark):
    """Three arrivals, the last with repeated messages; the folders and inbox files after each."""
    log = random_log(31, 150)
    parts = [log[:60], log[60:], log[20:80]]
    root, inbox, checkpoint, state_checkpoint = (fresh_path(spark, n) for n in ("store", "inbox", "stream", "state"))
    ingest = StreamIngest(spark, root)
    state = StateTable(spark, FOLDS["email_notifications"](), ingest.store, "email_notifications")
    before, inboxes = folders(spark), []
    for part in parts:
        frame(spark, part).write.mode("append").parquet(inbox)
        ingest.start(stream_messages(spark, inbox, consume=True), checkpoint, availableNow=True).awaitTermination()
        state.start(state_checkpoint, availableNow=True).awaitTermination()
        inboxes.append(len(parquet_files(inbox)))
    return ingest, state, folders(spark) - before - {root, inbox, checkpoint, state_checkpoint}, inboxes, log


def test_a_batch_leaves_its_tables_only(streamed):
    _, _, left, _, _ = streamed
    assert not left


def test_messages_go_once_a_later_batch_follows(streamed):
    # of three arrivals, the second run deletes the first one's file, the third the second one's
    assert streamed[3] == [1, 1, 1]


def test_consumed_messages_change_no_table(spark, streamed):
    ingest, state, _, _, log = streamed
    plain = StreamIngest(spark, fresh_path(spark, "store"))
    for i, part in enumerate([log[:60], log[60:], log[20:80]]):
        plain.ingest(frame(spark, part), "test", i)
    for name in ("events", "email_notifications", "email_status_history", "participants", "event_id_conflicts"):
        assert listed(ingest.table(name)) == listed(plain.table(name)), name
    assert listed(state.table()) == listed(plain.table("email_notifications"))


def test_stored_tables_are_packed(streamed):
    files = [f for f in parquet_files(streamed[0].store.root) if pq.ParquetFile(f).metadata.num_rows]
    assert files
    for file in files:
        meta = pq.ParquetFile(file).metadata
        assert meta.row_group(0).column(0).compression == "ZSTD", file


def test_claims_of_a_stored_log_are_numbers_alone(spark, streamed):
    ingest = streamed[0]
    entries = ingest.store.read(ingest.index.table)
    assert entries.columns == ["kind", "claim", "check"] and entries.count() > 0


def test_sharing_rows_come_from_the_log(spark):
    rng = random.Random(8)
    old, new = (materialize(rows_of(spark, rng, n, 150), "rows") for n in (120, 30))
    found = []
    for log in ("events", None):
        index = KeyIndex(TableStore(spark, fresh_path(spark, "store")), log=log)
        assert index.sharing(new) is None
        commit = index.store.begin()
        commit.append("events", old)
        index.add(commit, old)
        commit.publish()
        found.append(listed(index.sharing(new)))
        assert listed(index.contested(new).select(*_ORDER)) and index.sharing(new).columns == KEY_COLUMNS
    assert found[0] == found[1] and found[0]


def test_entries_of_a_bucket_lie_in_order(spark):
    store = TableStore(spark, fresh_path(spark, "store"), 4)
    commit = store.begin()
    commit.append("numbers", spark.range(500).select(F.xxhash64("id").alias("claim")), bucket_by=["claim"])
    commit.publish()
    for file in parquet_files(store.root):
        claims = pq.ParquetFile(file).read().column("claim").to_pylist()
        assert claims == sorted(claims)


def test_shuffles_go_with_their_batch_and_the_session_is_as_before(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f for d in local for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, conf = shuffles(), {key: spark.conf.get(key, None) for key in STREAM_CONF}
    StreamIngest(spark, fresh_path(spark, "store")).ingest(frame(spark, random_log(32, 60)), "test", 0)
    spark.sparkContext._jvm.java.lang.Thread.sleep(500)
    assert os.path.isdir(local[0]) and shuffles() <= before
    # else whoever collects a frame twice would compute it twice
    assert {key: spark.conf.get(key, None) for key in STREAM_CONF} == conf
