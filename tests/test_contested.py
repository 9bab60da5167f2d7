"""A batch is decided on the rows that share a claim; the others stay where they are."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from meetledger.operators import dedup
from meetledger.operators.dedup import _ORDER
from meetledger.session import fresh_path, materialize
from meetledger.sources.key_index import KEY_COLUMNS, KeyIndex
from meetledger.sources.tables import TableStore


def rows_of(spark, rng, n, ids):
    pick = lambda *values: rng.choice(values)
    day = datetime.datetime(2024, 1, 1)
    rows = [
        (day + datetime.timedelta(hours=rng.randrange(99)), f"e{rng.randrange(ids)}", pick("h1", f"h{i}"), pick("t", "u"), "s",
         pick(None, "b1", f"b{i}"), pick(None, "", "k1", f"k{rng.randrange(ids)}"), "q")
        for i in range(n)
    ]
    rows += rng.sample(rows, n // 5)
    schema = ", ".join(f"{c} {'timestamp' if c == 'received_at' else 'string'}" for c in _ORDER)
    return spark.createDataFrame(rows, schema).withColumn("payload_json", F.concat(F.lit("{}"), "payload_hash"))


def listed(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("few", [True, False])
def test_verdicts_equal_the_rules_over_all_rows(spark, few):
    rng = random.Random(5)
    old, new = rows_of(spark, rng, 120, 150), materialize(rows_of(spark, rng, 40 if few else 400, 300), "new")
    index = KeyIndex(TableStore(spark, fresh_path(spark, "store")))
    stored, _ = dedup.accept(old, "all", materialize)
    commit = index.store.begin()
    index.add(commit, stored)
    commit.publish()

    contested = index.contested(new)
    assert 0 < contested.count() < new.count()
    log, conflicts = dedup.settle(new, materialize(dedup.judge(contested, "all", materialize), "verdicts"), materialize)

    known = stored.select(*KEY_COLUMNS)
    fresh, taken = dedup.split_stored_ids(dedup.drop_stored(new, known), known)
    plain_log, plain_conflicts = dedup.accept(fresh, "all", materialize)
    plain_conflicts = plain_conflicts.unionByName(dedup.unclaimed(taken, plain_log))
    assert listed(log) == listed(plain_log)
    assert listed(conflicts) == listed(plain_conflicts) and conflicts.count() > 0


def test_rows_that_share_nothing_do_not_move(spark):
    rows = materialize(rows_of(spark, random.Random(6), 5, 9).select(*_ORDER, "payload_json"), "rows")
    alone = rows.limit(1).withColumns({"event_id": F.lit("x"), "idempotency_key": F.lit("y"), "booking_id": F.lit("z")})
    index = KeyIndex(TableStore(spark, fresh_path(spark, "store")))
    contested = index.contested(materialize(alone, "alone"))
    assert contested.isEmpty()
    log, conflicts = dedup.settle(alone, materialize(dedup.judge(contested, "all", materialize), "verdicts"), materialize)
    assert listed(log) == listed(alone) and conflicts.isEmpty()
    plan = log.join(rows.limit(0), "event_id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_a_claim_is_a_number_and_its_columns_are_kept_once(spark):
    rows = rows_of(spark, random.Random(7), 50, 99)
    index = KeyIndex(TableStore(spark, fresh_path(spark, "store")))
    commit = index.store.begin()
    index.add(commit, rows)
    commit.publish()
    entries = index.store.read(index.table)
    assert entries.schema["claim"].dataType.simpleString() == "bigint"
    assert entries.filter("columns IS NOT NULL").count() == rows.count() < entries.count()
