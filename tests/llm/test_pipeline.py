"""The pipeline's stages one after the other on a small corpus with planted cases."""

import random
import zlib

import corpus_pipeline
from meetledger.llm.queries import ORACLE, QUERIES
from tests.llm.cases import empty_frame, frame, sentence
from tests.llm.test_token_store import ids_of, tokenizer  # noqa: F401


def write_tables(spark, folder, rows, labels, items):
    frame(spark, rows, clash=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_planted_cases(spark, tmp_path, tokenizer):  # noqa: F811
    rng = random.Random(12)
    item = sentence(rng, 30)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        text = sentence(rng, rng.randint(30, 70))
        rows.append((i, text if good else text.replace(" ", "### "), "en", f"s{i % 3}", 0))
        labels.append((i, int(good), 0))
    good_text = rows[1][1]
    rows += [(900, good_text, "en", "s0", 0), (901, good_text + " tail", "en", "s1", 0), (902, f"{sentence(rng, 20)} {item}", "en", "s2", 0)]
    folder = str(tmp_path)
    write_tables(spark, folder, rows, labels, [(1, item)])
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        assert name == "tokens" or docs.columns == columns
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    bad = {i for i in range(300) if i % 4 == 0}
    assert len(bad & set(seen["quality"])) <= 5
    assert len(set(range(300)) - bad - set(seen["quality"])) <= 3
    assert set(seen["quality"]) - set(seen["near_duplicates"]) == {900, 901}
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {902}
    assert set(seen["mixture"]) <= set(seen["decontamination"])
    texts = {r[0]: r[1] for r in rows}
    at = 0
    for r in docs.orderBy("start").collect():
        ids = ids_of(tokenizer, texts[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert sorted(seen["tokens"]) == sorted(seen["mixture"])


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    write_tables(spark, folder, [(1, "x", "en", "s", 0)], [(1, 1, 0)], [(1, "x")])
    docs = empty_frame(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.collect() == []


def test_queries_of_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "tokens"]
