import random

import pytest
from pyspark.sql import functions as F

from meetledger.llm import factorization
from meetledger.llm.factorization import classify, held_out, keep_good, training_rows
from tests.llm.cases import awkward_rows, empty_frame, frame, sentence


def corpus(rng, n=500):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = sentence(rng, rng.randint(20, 80))
        if not good:
            text = text.upper() if i % 2 else text.replace(" ", "### ")
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(random.Random(2))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + awkward_rows())
    got = classify(docs, marks).collect()
    assert len(got) == len(rows) + len(awkward_rows())
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    kept = keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["predicted"])


def test_no_held_out_row_trains_and_the_bound_holds(spark):
    rows, labels = corpus(random.Random(3), 200)
    marks = spark.createDataFrame(labels + labels[:5] + [(None, 1, 0), (999_999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    usable = marks.dropDuplicates(["doc_id"]).where(~held_out(F.col("doc_id")) & (F.col("doc_id") < 200)).count()
    assert training_rows(docs, marks).count() == usable
    assert training_rows(docs, marks, most=30).count() == 30


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1_004, 1, 0)], 1.0), ([(1_004, 0, 0)], 0.0)])
def test_without_two_classes(spark, labels, score):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    expected = score if not labels or zlib_fold(1_004) else 0.5
    got = classify(frame(spark, awkward_rows()), marks).collect()
    assert {r["score"] for r in got} == {expected}
    assert factorization.THRESHOLD == 0.3


def zlib_fold(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 5 != 0


def test_empty_table(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert classify(empty_frame(spark), marks).collect() == []
