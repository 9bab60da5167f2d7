import random
import zlib

import numpy as np
import pytest

from meetledger.llm import token_store
from meetledger.llm.queries import tokenizer_file
from meetledger.session import fresh_path
from tests.llm.cases import awkward_rows, empty_frame, frame, sentence


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizer_file())
    loaded.encode_special_tokens = True
    return loaded


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_words_learned_once_give_the_ids_of_the_whole_text(tokenizer):
    rng = random.Random(1)
    parts = ["a", "b ", "\n", " ", "  ", "é", "!", "'s", "\t", "word ", "Word\n", "12", "ß.", "<|endoftext|>", "　", "don't", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1_500)] + ["", None]
    encode = token_store.Encoder(tokenizer_file())
    for text, content in zip(texts, encode(texts), strict=True):
        assert np.array_equal(np.frombuffer(content, "<u2"), ids_of(tokenizer, text)), repr(text)


def test_round_trip(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "DOCS_PER_SHARD", 40)
    monkeypatch.setattr(token_store, "BLOCK_DOCS", 7)
    rng = random.Random(2)
    rows = awkward_rows() + [(i, sentence(rng, rng.randint(0, 60)), "en", "s", 0) for i in range(300)]
    docs = frame(spark, rows)
    path = fresh_path(spark, "store")
    token_store.write_store(docs, path, tokenizer_file())
    got = token_store.read_documents(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is None, i))
    texts = {r[0]: r[1] for r in rows}
    at = 0
    for r in got:
        ids = ids_of(tokenizer, texts[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert np.array_equal(token_store.read_ids(spark, path, 1_005), ids_of(tokenizer, texts[1_005]))
    assert token_store.read_ids(spark, path, 5_000) is None
    blocks = spark.read.parquet(f"{path}/blocks")
    digest = spark.read.parquet(f"{path}/dictionary").first()["hash"]
    assert {r["dictionary"] for r in blocks.select("dictionary").collect()} == {digest}
    assert blocks.count() > 40 and blocks.select("shard").distinct().count() > 4


def test_another_dictionary_is_refused(spark):
    path = fresh_path(spark, "store")
    token_store.write_store(frame(spark, awkward_rows()), path, tokenizer_file())
    spark.createDataFrame([("other", bytearray())], "hash string, content binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        token_store.read_documents(spark, path).collect()


def test_empty_table(spark):
    assert token_store.round_trip(empty_frame(spark), tokenizer_file()).collect() == []


def test_added_tokens_in_texts_have_their_own_ids(spark):
    """Against the library as it is loaded."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file())
    rng = random.Random(3)
    parts = ["a", "b ", "\n", " ", "é", "word ", "<|endoftext|>", "<|endof", "text|>", "<|", "|>"]
    texts = ["a <|endoftext|>b", "<|endoftext|>", "a <|endoftext| >b"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    want = {i: ids_of(plain, t) for i, t in enumerate(texts)}
    assert 50256 in want[0]
    got = {r["doc_id"]: r for r in token_store.round_trip(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), tokenizer_file()).collect()}
    assert {i: (r["n_tokens"], r["ids_crc32"]) for i, r in got.items()} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


def test_new_words_are_encoded_in_short_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "KNOWN_WORDS", 3_000)
    monkeypatch.setattr(token_store, "LASTING_WORDS", 1_000)
    rng = random.Random(8)
    ends = ["", "!", "'s", "Ġ", "é", "Ġa", "12", "-ß", "¿", "日本"]
    words = ["".join(rng.choice("abcdeXYZ") for _ in range(rng.randint(1, 7))) + rng.choice(ends) for _ in range(2_500)]
    texts = ["".join(rng.choice(words) + rng.choice("  \n ") for _ in range(400)) + "end" for _ in range(40)]
    texts = [" ".join(line for line in t.split(" ") if line).replace(" \n", "\n") for t in texts]
    encode = token_store.Encoder(tokenizer_file())
    library, seen = encode.tokenizer, []

    class Watched:
        def encode_batch_fast(self, some, **options):
            seen.extend(some)
            return library.encode_batch_fast(some, **options)

    encode.tokenizer = Watched()
    for start in range(0, 40, 10):
        some = texts[start : start + 10]
        for text, content in zip(some, encode(some), strict=True):
            assert np.array_equal(np.frombuffer(content, "<u2"), ids_of(tokenizer, text)), repr(text)
    learned = [t for t in seen if t not in texts]
    assert learned and max(len(t.split()) for t in learned) <= token_store.LEARN_WORDS


def test_texts_encoded_together_are_bounded(monkeypatch):
    monkeypatch.setattr(token_store, "ENCODE_CHARS", 10)
    cut = lambda texts: [(s.start, s.stop) for s in token_store._slices(texts)]
    assert cut([]) == [] and cut([None, "", "x" * 50]) == [(0, 2), (2, 3)]
    assert cut(["x" * 50, "abcde", "fghij", "k", None]) == [(0, 1), (1, 3), (3, 5)]


def test_words_in_one_piece_have_the_ids_of_the_library(tokenizer):
    """Letters, digits and signs of any order and alphabet; words of other characters go the long way."""
    rng = random.Random(9)
    signs = [*"abzAZéßöÇÿ019.,;:-_(&#*\"'", "'s", "'ll", "n't", "×", "÷", "²", "ª", "œ", "ı", "—", "’s", "漢", "é", "😀", "...", "***", "12.5"]
    words = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(6_000)]
    texts = ["".join(rng.choice(words) + rng.choice("   \n") for _ in range(60)) + "end" for _ in range(200)]
    encode = token_store.Encoder(tokenizer_file())
    assert encode.quick is not None
    for _ in range(2):  # learned, then partly known
        for text, content in zip(texts, encode(texts), strict=True):
            assert np.array_equal(np.frombuffer(content, "<u2"), ids_of(tokenizer, text)), repr(text)


def test_ids_over_a_cut_forbid_one_piece(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    for merge in [("e", ","), ("Ċ", "e"), ("e", "Ġ"), ("1", "a"), ("e", "d")]:
        made = Tokenizer(models.BPE({c: i for i, c in enumerate([*letters, "".join(merge)])}, [merge]))
        made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        made.save(path := f"{tmp_path}/tokenizer.json")
        encode = token_store.Encoder(path)
        assert (encode.quick is not None) == (merge == ("e", "d"))
        for text in ["he, she\nend 1a", "e", "re, ed\nre,"]:
            assert np.array_equal(np.frombuffer(encode([text])[0], "<u2"), ids_of(made, text)), (merge, text)


def test_words_met_once_are_not_kept():
    encode = token_store.Encoder(tokenizer_file())
    encode(["one two", "three\nfour"])
    assert not encode.known
    encode(["two one", "six two"])
    assert set(encode.known) == {"two"}  # the others are new, or stand elsewhere in a line
    assert encode(["one two"]) == encode(["one two"]) and set(encode.known) == {"two", "\none"}
