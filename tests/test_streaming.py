"""The stream builds what the batch plan builds, for any cut of the log."""

import pytest

from meetledger.plans import pipeline
from meetledger.schemas import MESSAGE_SCHEMA
from meetledger.session import fresh_path
from meetledger.sources.messages import stream_messages
from meetledger.streaming.ingest import StreamIngest
from pyspark.sql import functions as F
from tests.messages import random_log
from tests.one_by_one import Ledger
from tests.test_against_one_by_one import compare


def frame(spark, log):
    return spark.createDataFrame([(m["headers"], m["body"], m["queue"], m["received_at"]) for m in log], MESSAGE_SCHEMA)


def one_by_one(log):
    ledger = Ledger()
    for message in log:
        ledger.receive(message)
    return ledger


class Tables:
    def __init__(self, tables):
        self.tables = tables


@pytest.mark.parametrize("cuts", [1, 3])
def test_batches_equal_one_by_one(spark, cuts):
    log = random_log(11, 240)
    ingest = StreamIngest(spark, fresh_path(spark, "store"))
    size = -(-len(log) // cuts)
    for i in range(cuts):
        ingest.ingest(frame(spark, log[i * size : (i + 1) * size]), "test", i)
    ledger = one_by_one(log)
    compare(Tables(ingest.tables()), ledger)

    # a batch that is delivered again, and compaction, change nothing
    assert ingest.ingest(frame(spark, log[:size]), "test", 0) is None
    ingest.compact()
    compare(Tables(ingest.tables()), ledger)


def test_redelivered_messages_change_nothing(spark):
    log = [m for m in random_log(12, 80, odd=False) if m["headers"].get("ce-booking_id")]
    ingest = StreamIngest(spark, fresh_path(spark, "store"))
    ingest.ingest(frame(spark, log), "test", 0)
    before = {n: sorted(map(repr, t.collect())) for n, t in ingest.tables().items()}
    # the same messages once more, as a new batch
    ingest.ingest(frame(spark, log), "test", 1)
    assert {n: sorted(map(repr, t.collect())) for n, t in ingest.tables().items()} == before


def test_structured_stream(spark):
    log = random_log(13, 120)
    inbox = fresh_path(spark, "inbox")
    for i in range(3):
        frame(spark, log[i * 40 : (i + 1) * 40]).coalesce(1).write.mode("append").parquet(inbox)
    ingest = StreamIngest(spark, fresh_path(spark, "store"))
    checkpoint = fresh_path(spark, "checkpoint")
    for _ in range(2):  # the second run finds nothing new
        query = ingest.start(stream_messages(spark, inbox, max_files_per_trigger=1), checkpoint, availableNow=True)
        query.awaitTermination()
    assert ingest.store.manifest()["commit"] == 2
    compare(Tables(ingest.tables()), one_by_one(log))
    batch = pipeline.run_messages(spark.read.schema(MESSAGE_SCHEMA).parquet(inbox))
    assert batch["events"].count() == ingest.table("events").count()


def test_unpublished_commit_is_invisible(spark):
    ingest = StreamIngest(spark, fresh_path(spark, "store"))
    ingest.store.save({"t": spark.range(3)})
    commit = ingest.store.begin()
    commit.append("t", spark.range(5))
    assert ingest.store.read("t").count() == 3
    # the next attempt takes the same number and overwrites the leftovers
    again = ingest.store.begin()
    assert again.number == commit.number
    again.append("t", spark.range(1))
    again.publish()
    assert ingest.store.read("t").count() == 4
    assert ingest.store.read("absent") is None


def test_bounded_dedup(spark):
    from meetledger.operators.dedup import bounded_dedup
    from meetledger.sources.messages import decode_messages, valid_envelopes

    log = random_log(14, 150, odd=False)
    inbox = fresh_path(spark, "inbox")
    frame(spark, log).coalesce(1).write.parquet(inbox)
    out = fresh_path(spark, "out")
    rows = bounded_dedup(valid_envelopes(decode_messages(stream_messages(spark, inbox))), "30 days")
    query = rows.writeStream.format("parquet").option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    kept = spark.read.parquet(out)
    keyed = kept.filter(F.coalesce("idempotency_key", F.lit("")) != "")
    assert keyed.count() == keyed.select("idempotency_key").distinct().count()
    assert kept.count() < len(log)
