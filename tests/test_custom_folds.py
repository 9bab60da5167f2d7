"""User projections that are folds: the stream keeps what a batch would build, for any cut of the log."""

import pytest

from meetledger.operators.folds import Fold, first, greatest, latest
from meetledger.plans import pipeline
from meetledger.plans.registry import FoldedProjection, Registry
from meetledger.session import fresh_path
from meetledger.streaming.ingest import StreamIngest
from pyspark.sql import functions as F
from tests.messages import random_log
from tests.test_streaming import frame


def registry():
    made = Registry()
    columns = {"first_type": first(F.col("event_type")), "last_id": latest(F.col("event_id")), "newest": greatest(F.col("occurred_at"))}
    made.register(FoldedProjection("activity", F.col("booking_id").isNotNull(), Fold(["booking_id"], columns)))
    by_kind = Fold(["booking_id", "kind"], {"last_id": latest(F.col("event_id"))})
    kind = F.substring_index("event_type", ".", 1).alias("kind")
    made.register(FoldedProjection("kinds", F.lit(True), by_kind, lambda log: log.select("booking_id", kind, "event_id", "received_at")))
    made.register(FoldedProjection("broken", F.lit(True), by_kind, lambda log: log.select("no_such_column")))
    return made


def content(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("cuts", [1, 3])
def test_stream_equals_batch_and_plain_python(spark, cuts):
    log = random_log(31, 150)
    ingest = StreamIngest(spark, fresh_path(spark, "store"), registry=registry())
    size = -(-len(log) // cuts)
    for i in range(cuts):
        ingest.ingest(frame(spark, log[i * size : (i + 1) * size]), "test", i)
    assert list(ingest.registry.failures) == ["broken"]

    batch = pipeline.build_tables(ingest.table("events"), ingest.table("facts"), registry(), persist=False)
    before = {name: content(ingest.table(name)) for name in ("activity", "kinds")}
    assert before == {name: content(batch[name]) for name in before} and "broken" not in batch

    events = sorted(ingest.table("events").collect(), key=lambda r: (r["received_at"], r["event_id"]))
    want = {}
    for r in events:
        if r["booking_id"] is not None:
            old = want.get(r["booking_id"])
            newest = max((t for t in (old and old[2], r["occurred_at"]) if t is not None), default=None)
            want[r["booking_id"]] = (old[0] if old else r["event_type"], r["event_id"], newest)
    assert {r["booking_id"]: (r["first_type"], r["last_id"], r["newest"]) for r in ingest.table("activity").collect()} == want

    # A batch that comes again, and compaction, change nothing.
    assert ingest.ingest(frame(spark, log[:size]), "test", 0) is None
    ingest.compact()
    assert {name: content(ingest.table(name)) for name in before} == before


def test_names_are_taken_once_and_plain_projections_stay_out(spark):
    made = registry()
    with pytest.raises(ValueError):
        made.register(FoldedProjection("kinds", F.lit(True), Fold(["a"], {})))
    assert list(made.folded) == ["custom_activity", "custom_kinds", "custom_broken"]
