"""Token-ID output: documents compressed one by one with a shared zstandard dictionary.

A store is a folder of two parquet tables. ``dictionary`` holds the trained dictionary and
its hash. ``blocks`` holds the documents in ascending id order: a row is a block of up to
``BLOCK_DOCS`` documents, with their ids, the token count of each, the offset of each one's
zstandard frame, the width of an id in bytes, the hash of the dictionary, and the frames.
One document is read by its block's offset index and one decompression.

The dictionary is trained on the serialized ids of about ``SAMPLE_DOCS`` documents of up to
``SAMPLE_CHARS`` characters, drawn by a hash of the id: short documents are what it is for.
Everything else covers all documents: they are encoded and compressed where they are read,
dealt to shards of id ranges, sorted, and gathered into blocks as a stream. Files are
written by Spark, so that a lost task is written again and no part file is seen twice.

Ids are those of the library's plain ``encode(add_special_tokens=False)``: an added token in a
text has its own id.

Cases: a missing or empty text is the end id alone; a missing id comes last; repeated ids
are kept, all of them; long texts may fill a block alone; an empty table gives an empty
store; further columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, compress, count, islice
from operator import not_

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from meetledger.llm.common import kept, narrow, small_batches
from meetledger.session import fresh_path

END_ID = 0
LEVEL = 1
DICTIONARY_BYTES = 64 * 1024
SAMPLE_DOCS, SAMPLE_CHARS = 2_000, 8_000
BLOCK_DOCS, BLOCK_BYTES = 64, 1 << 20
DOCS_PER_SHARD = 8_192
KNOWN_WORDS, LASTING_WORDS = 600_000, 450_000
SEEN_PLACES = 1 << 23
LEARN_WORDS = 200  # in a text that is encoded; the library takes more time for a word of a longer one
ENCODE_CHARS = 1 << 18  # of texts encoded at once

# Between two characters that are not white space, the tokenizer always splits before a
# single blank and around a single line feed; so words can be encoded once and reused.
# Texts with any other white space, or more of it in a row, are encoded whole.
_OTHER_WHITE = re.compile("[\\t\\r\\x0b\\f\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
_RUNS = ("  ", "\n\n", " \n", "\n ")

# Characters that words encoded in one piece may not have: all but ASCII without the apostrophe, and the letters from
# \u00c0 to \u00ff. The bytes of such words as ByteLevel writes them: letters (\u00c3 is the first byte of those beyond ASCII,
# the next ones are their second bytes), digits, signs, line feed and blank.
_NOT_QUICK = re.compile("[^\n !-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
_LETTERS, _DIGITS, _SIGNS, _LINE, _BLANK = "A-Za-z\u00c3\u00a1-\u00ac\u00ae-\u00bf\u0122-\u0143", "0-9", "!-&(-/:-@\\[-`{-~", "\u010a", "\u0120"
_ANY = f"[{_LETTERS}{_DIGITS}{_SIGNS}{_LINE}{_BLANK}]*"
# A token that could arise over a cut of such words.
_SPANS = re.compile(
    f"{_ANY}(?:[{_LETTERS}][{_DIGITS}{_SIGNS}]|[{_DIGITS}][{_LETTERS}{_SIGNS}]|[{_SIGNS}][{_LETTERS}{_DIGITS}]"
    f"|[{_LETTERS}{_DIGITS}{_SIGNS}][{_LINE}{_BLANK}]|{_LINE}[{_LETTERS}{_DIGITS}{_SIGNS}]){_ANY}"
)

_FRAMES = "shard int, doc_id long, n_tokens long, frame binary, width int"
_BLOCKS = (
    "shard int, block int, dictionary string, width int, doc_ids array<long>, n_tokens array<long>, "
    "offsets array<long>, n_ids long, frames binary"
)


class Encoder:
    """Ids of whole texts by the tokenizers library, remembering the words it has met."""

    def __init__(self, tokenizer_file: str, special_as_text: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = special_as_text
        # Texts that hold one of these are encoded whole.
        self.added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}  # by word after a blank, or by line feed and word
        self.seen, self.n_seen = np.zeros(SEEN_PLACES, bool), 0  # by hash of a word that was learned
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.end = np.array([END_ID], f"<u{self.width}").tobytes()
        self.line = self._whole("\n")
        # An added token with white space in it could arise between words that are learned together.
        self.splits = len(self.line) == self.width and not any(c.isspace() for token in self.added for c in token)
        # The ids that begin with a blank or a line feed, where blanks and bytes are written as characters of their own.
        self.begins = None
        if self.splits and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None:
            self.begins = np.zeros(1 << 8 * self.width if self.width == 2 else self.tokenizer.get_vocab_size(), bool)
            self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
            self.begins[np.frombuffer(self.line, f"<u{self.width}")] = True
        self.quick = self._in_one_piece() if self.begins is not None else None

    def _in_one_piece(self) -> Tokenizer | None:
        """The tokenizer that leaves out the cutting of a text before its ids are made, if no id can span a cut.

        Without apostrophes (\u2018's\u2019 is a piece, whatever follows) a text is cut where letters, digits
        and signs meet and in front of white space. In words without ``_NOT_QUICK`` each byte tells which it is.
        """
        model, cutter = self.tokenizer.model, self.tokenizer.pre_tokenizer
        plain = type(model).__name__ == "BPE" and not (model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix)
        if not plain or not cutter.use_regex or cutter.add_prefix_space or any(map(_SPANS.fullmatch, self.tokenizer.get_vocab(with_added_tokens=False))):
            return None
        quick = Tokenizer(model)
        quick.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        return quick

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")

    def _whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new words."""
        if self.quick is None:
            return self._encode_words(words, self.tokenizer)
        odd = dict.fromkeys(filter(_NOT_QUICK.search, words))
        learned = self._encode_words([word for word in words if word not in odd] if odd else words, self.quick)
        return learned | self._encode_words(list(odd), self.tokenizer)

    def _encode_words(self, words: list[str], tokenizer: Tokenizer) -> dict[str, bytes]:
        """Many words encoded after one another, the ids cut where a word begins."""
        if not words:
            return {}
        lead = "\n " if self.begins is None else " "
        leads = ["" if word[0] == "\n" else lead for word in words]
        texts = ["".join(chain.from_iterable(zip(leads[k : k + LEARN_WORDS], words[k : k + LEARN_WORDS], strict=True))) for k in range(0, len(words), LEARN_WORDS)]
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), f"<u{self.width}")
        starts = np.flatnonzero(ids == np.frombuffer(self.line, ids.dtype)[0] if self.begins is None else self.begins[ids])
        ends = np.append(starts[1:], len(ids)) * self.width
        # a blank belongs to its word, a line feed in front of it does not
        extra = np.array([len(x) > 1 for x in leads]) if self.begins is None else 0
        content = ids.tobytes()
        cut = map(slice, ((starts + extra) * self.width).tolist(), ends.tolist())
        return dict(zip(words, map(content.__getitem__, cut), strict=True))

    def _keep(self, learned: dict[str, bytes]) -> None:
        """Words are kept when they are learned again: most of them are met once."""
        hashes = np.fromiter(map(hash, learned), np.int64, len(learned)) & (SEEN_PLACES - 1)
        self.known.update(compress(learned.items(), self.seen[hashes].tolist()))
        self.seen[hashes] = True
        self.n_seen += len(hashes)
        if self.n_seen > SEEN_PLACES // 2:
            self.seen[:], self.n_seen = False, 0
        if len(self.known) > KNOWN_WORDS:
            self.trim()

    def trim(self) -> None:
        """Keep the words met first, which are the frequent ones."""
        for word in list(islice(self.known, LASTING_WORDS, None)):
            del self.known[word]

    def _regular(self, text: str) -> bool:
        if not text or not self.splits or text[0] in " \n" or text[-1] in " \n":
            return False
        if any(run in text for run in _RUNS) or any(token in text for token in self.added):
            return False
        # other white space does not count as printable
        return text.replace("\n", "").isprintable() or not _OTHER_WHITE.search(text)

    def _batch(self, texts: list[str]) -> list[bytes]:
        """Serialized ids of regular texts: all words are looked up together."""
        if not texts:
            return []
        # A text counts as a line of its own; its line feed's id is cut off.
        words = "\n".join(["", *texts]).replace("\n", " \n")[1:].split(" ")
        found = list(map(self.known.get, words))
        new = list(compress(count(), map(not_, found)))
        if new:
            learned = self._learn(list(dict.fromkeys(map(words.__getitem__, new))))
            for k in new:
                found[k] = learned[words[k]]
            self._keep(learned)
        rest = iter(found)
        return [b"".join(islice(rest, t.count(" ") + t.count("\n") + 1))[self.width :] + self.end for t in texts]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The serialized ids of each text, end id included."""
        regular = [self._regular(t or "") for t in texts]
        quick = iter(self._batch([t for t, ok in zip(texts, regular, strict=True) if ok]))
        return [next(quick) if ok else self._whole(t or "") + self.end for t, ok in zip(texts, regular, strict=True)]


def encoder(tokenizer_file: str) -> Encoder:
    """The Python worker's encoder, which keeps its words from task to task; added tokens have their own ids."""
    return kept(("encoder", tokenizer_file), lambda: Encoder(tokenizer_file, special_as_text=False))


def _slices(texts: pd.Series) -> Iterator[slice]:
    """Texts that are encoded together: ``ENCODE_CHARS``, or a longer one alone."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > start and size + n > ENCODE_CHARS:
            yield slice(start, k)
            start, size = k, 0
        size += n
    if len(texts):
        yield slice(start, len(texts))


def train_dictionary(docs: DataFrame, tokenizer_file: str) -> bytes:
    """The dictionary of the sampled documents; empty when they are too few to train on."""
    read = narrow(docs, doc_id="long", text="string").where(F.col("doc_id").isNotNull())
    every = max(1, read.count() // SAMPLE_DOCS)
    short = F.length("text").between(1, SAMPLE_CHARS) & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def serialize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_file)
        for batch in batches:
            yield pd.DataFrame({"ids": encode(batch["text"].tolist())})

    # Bounded by the sample, not by the table; ids repeated without end are cut here.
    found = read.where(short).limit(2 * SAMPLE_DOCS).select("text").mapInPandas(serialize, "ids binary").collect()
    samples = sorted(bytes(r["ids"]) for r in found)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _bounds(docs: DataFrame) -> np.ndarray:
    """The least ids of all shards but the first: one number for every ``DOCS_PER_SHARD`` rows."""
    ids = narrow(docs, doc_id="long").where(F.col("doc_id").isNotNull())
    shards = ids.count() // DOCS_PER_SHARD + 1
    if shards == 1:
        return np.array([], np.int64)
    at = [k / shards for k in range(1, shards)]
    return np.unique(np.array(ids.agg(F.percentile_approx("doc_id", at, 10 * shards)).first()[0], np.int64))


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def write_store(docs: DataFrame, path: str, tokenizer_file: str) -> None:
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    content = train_dictionary(docs, tokenizer_file)
    digest = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(digest, bytearray(content))], "hash string, content binary").coalesce(1).write.parquet(f"{path}/dictionary")
    bounds = _bounds(docs)
    shared = spark.sparkContext.broadcast((content, bounds))

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        content, bounds = shared.value
        encode = encoder(tokenizer_file)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(content)).compress
        for batch in batches:
            ids = batch["doc_id"]
            shard = np.where(ids.isna(), len(bounds) + 1, np.searchsorted(bounds, ids.fillna(0).astype("int64"), side="right"))
            for some in _slices(batch["text"]):
                arrays = encode(batch["text"].iloc[some].tolist())
                yield pd.DataFrame(
                    {
                        "shard": shard[some].astype("int32"),
                        "doc_id": ids.iloc[some].astype("Int64").array,
                        "n_tokens": [len(a) // encode.width for a in arrays],
                        "frame": [squeeze(a) for a in arrays],
                        "width": np.int32(encode.width),
                    }
                )

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size, block, shard = 0, 0, None

        def close() -> pd.DataFrame:
            frames = [h[2] for h in held]
            return pd.DataFrame(
                {
                    "shard": [shard], "block": [block], "dictionary": [digest], "width": [held[0][3]],
                    "doc_ids": [[h[0] for h in held]], "n_tokens": [[h[1] for h in held]],
                    "offsets": [np.concatenate(([0], np.cumsum([len(f) for f in frames]))).tolist()],
                    "n_ids": [sum(h[1] for h in held)], "frames": [b"".join(frames)],
                }
            )

        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"].astype("object")]
            for s, i, n, frame, width in zip(batch["shard"], ids, batch["n_tokens"], batch["frame"], batch["width"], strict=True):
                if held and (s != shard or len(held) == BLOCK_DOCS or size + len(frame) > BLOCK_BYTES):
                    yield close()
                    held, size, block = [], 0, block + 1 if s == shard else 0
                shard = s
                held.append((i, n, frame, width))
                size += len(frame)
        if held:
            yield close()

    framed = narrow(docs, doc_id="long", text="string").mapInPandas(compress, _FRAMES)
    dealt = framed.repartition(len(bounds) + 2, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "n_tokens", "frame")
    dealt.mapInPandas(gather, _BLOCKS).write.parquet(f"{path}/blocks")


def _starts(blocks: DataFrame) -> DataFrame:
    """How many ids come before each block, from the block heads alone."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row for every DOCS_PER_SHARD documents.
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = totals.select("shard", before.alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    heads = blocks.select("shard", "block", F.coalesce(inside, F.lit(0)).alias("inside"))
    return heads.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("block_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decompressed from the store."""
    # One row, of at most DICTIONARY_BYTES.
    digest, content = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast(bytes(content))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value)).decompress
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.dictionary != digest:
                    raise ValueError(f"block {row.shard}/{row.block} was written with another dictionary")
                frames = memoryview(row.frames)
                crcs = []
                for at, end in zip(row.offsets[:-1], row.offsets[1:], strict=True):
                    ids = np.frombuffer(expand(frames[at:end]), f"<u{row.width}")
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                n = np.asarray(row.n_tokens, np.int64)
                yield pd.DataFrame(
                    {
                        "shard": row.shard, "block": row.block, "doc_id": pd.array(list(row.doc_ids), "Int64"),
                        "inside": np.cumsum(n) - n, "n_tokens": n, "ids_crc32": np.array(crcs, np.int64),
                    }
                )

    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    each = blocks.mapInPandas(decode, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    both = each.join(_starts(blocks.select("shard", "block", "n_ids")), ["shard", "block"])
    return both.select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document: one block read, one frame decompressed."""
    digest, content = spark.read.parquet(f"{path}/dictionary").first()
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    row = blocks.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).first()
    if row is None:
        return None
    if row["dictionary"] != digest:
        raise ValueError(f"block {row['shard']}/{row['block']} was written with another dictionary")
    k = row["doc_ids"].index(doc_id)
    frame = bytes(row["frames"][row["offsets"][k] : row["offsets"][k + 1]])
    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(content))).decompress
    return np.frombuffer(expand(frame), f"<u{row['width']}").astype("<u4")


def round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write a store of the documents in the shared folder and read it back."""
    path = fresh_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer_file)
    return read_documents(docs.sparkSession, path)
