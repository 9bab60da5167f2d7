"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text are replaced with typed placeholders; what is left is a
template. Windows of ``WINDOW`` words of the templates of documents and benchmark items
are joined by hash. For every document, item and offset at which windows meet, the values
behind the placeholders must fit together: one value of the item is one and the same value
of the document. So a question with other numbers is caught, and a coincidence of a
template with unrelated values is not. A window with the item's own values always counts,
and so does one whose changed values fit; only windows that hold a clashing value do not.
The ``strict`` form wants the values to fit the other way round too, and gives up an offset
with any clash. A document is contaminated by an item when ``COVERAGE`` of the item's
windows meet consistently.

A window of mostly placeholders says little: it is compared by its words. Items of fewer
words than a window are one window of their own length; below ``LEAST_WORDS`` they only
match a document that consists of nothing else.

The windows of all documents are made and hashed where they are read. A bitmap of the
benchmark's hashes, of bounded size, lets only windows pass that may have a partner; the
join decides. A fuller bitmap lets more pass and changes no result.

Cases: a missing or empty text or item has no windows and meets nothing; repeated rows of
documents count once for each (doc_id, text); repeated items are told apart by item_id; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetledger.llm.common import bitmap_of, in_bitmap, kept, narrow, row_key, small_batches, store

WINDOW, LEAST_WORDS, COVERAGE = 8, 5, 0.3
FILTER_BITS = (20, 25)
BLOCK_CHARS = 1 << 18  # of text at once
# Units that may follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg t oz lb lbs "
    "gram grams kilogram kilograms ton tons pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons s sec min h hr hrs "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur gbp "
    "percent degrees mph kmh stunden minuten tage wochen jahre heures jours semaines ans horas minutos dias semanas".split()
)
NUMBER, NAME, UNIT = 1, 2, 3
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?]|[€$£%]")
_MARKS = frozenset(".!?")
_SIGNS = frozenset("€$£%")
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


# What a token is, in the lowest bits of its number; _SEVERAL is a word of several tokens.
_PLAIN, _MARK, _DIGITS, _SIGN, _UNIT_WORD, _CAPITAL, _NOTHING, _SEVERAL = range(8)
_ENDS = 8


class Vocabulary(dict):
    """Words as 60 bits of a hash of their small letters, a bit for the end of a sentence, and their kind."""

    MOST, LASTING = 200_000, 100_000
    PLACES = 1 << 22

    def __init__(self) -> None:
        self.seen, self.n_seen = bytearray(self.PLACES), 0  # by hash of a word

    def __missing__(self, word: str) -> int:
        """A word is kept when it is missed again: most of them are met once."""
        if len(self) > self.MOST:
            # the words met first are the frequent ones
            for late in list(self)[self.LASTING :]:
                del self[late]
        small = word.lower()
        if word.isalpha() and word == small and word not in UNITS:
            # most words: one token of small letters
            value = xxhash.xxh64_intdigest(small.encode("utf-8", "surrogatepass")) & ~15 | _PLAIN
        else:
            value = self._number(_TOKEN.findall(word))
        place = hash(word) & (self.PLACES - 1)
        if self.seen[place]:
            self[word] = value
            return value
        self.seen[place] = 1
        self.n_seen += 1
        if self.n_seen > self.PLACES // 2:
            self.seen, self.n_seen = bytearray(self.PLACES), 0
        return value

    @staticmethod
    def _number(tokens: list[str]) -> int:
        if not tokens:
            return _NOTHING
        token, marks = tokens[0], tokens[1:]
        if len(tokens) > 1 and (token in _MARKS or any(m not in _MARKS for m in marks)):
            return _SEVERAL
        small = token.lower()
        if token in _MARKS:
            kind = _MARK
        elif token[0].isdigit():
            kind = _DIGITS
        elif token in _SIGNS:
            kind = _SIGN
        elif small in UNITS:
            kind = _UNIT_WORD
        else:
            kind = _CAPITAL if token[0] != small[0] and token[1:] == small[1:] else _PLAIN
        return xxhash.xxh64_intdigest(small.encode("utf-8", "surrogatepass")) & ~15 | (_ENDS if marks else 0) | kind


def vocabulary() -> Vocabulary:
    """What the Python worker has met, kept from task to task."""
    return kept("vocabulary", Vocabulary)


_PLACES = np.array([0, *(zlib.crc32(name) + (1 << 40) for name in (b"num", b"name", b"unit"))], np.uint64)


def _blocks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts in turn, as many as ``BLOCK_CHARS`` hold, and the place of the first; a longer text is a block of its own."""
    start, block, size = 0, [], 0
    for text in texts:
        text = text or ""
        if block and size + len(text) > BLOCK_CHARS:
            yield start, block
            start, block, size = start + len(block), [], 0
        block.append(text)
        size += len(text)
    if block:
        yield start, block


def _split(texts: list[str], known: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of texts, their numbers and which text they are of; a word of several tokens gives its tokens."""
    each = [text.split() for text in texts]
    words = list(chain.from_iterable(each))
    of = np.repeat(np.arange(len(texts)), [len(w) for w in each])
    numbers = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    several = np.flatnonzero(numbers & np.uint64(7) == _SEVERAL)
    if not len(several):
        return words, numbers, of
    tokens = [_TOKEN.findall(words[k]) for k in several.tolist()]
    whole, at = [], 0
    for k, parts in zip(several.tolist(), tokens, strict=True):
        whole += words[at:k]
        whole += parts
        at = k + 1
    whole += words[at:]
    times = np.ones(len(words), np.int64)
    times[several] = [len(parts) for parts in tokens]
    cut = np.repeat(numbers & np.uint64(7) == _SEVERAL, times)
    numbers = np.repeat(numbers, times)
    numbers[cut] = np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), np.uint64, int(cut.sum()))
    return whole, numbers, np.repeat(of, times)


def _canonical(texts: list[str], known: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``canonical`` gives of each text, one after another, and which text it is of."""
    words, numbers, of = _split(texts, known)
    kinds = (numbers & np.uint64(7)).astype(np.int8)
    seen = np.flatnonzero(kinds != _NOTHING)
    numbers, kinds, of = numbers[seen], kinds[seen], of[seen]
    first = np.ones(len(kinds), bool)
    first[1:] = (of[1:] != of[:-1]) | (kinds[:-1] == _MARK) | (numbers[:-1] & np.uint64(_ENDS) > 0)
    after_number = np.zeros(len(kinds), bool)
    after_number[1:] = (kinds[:-1] == _DIGITS) & ~first[1:]
    held = np.zeros(len(kinds), np.int8)
    held[kinds == _DIGITS] = NUMBER
    held[(kinds == _SIGN) | ((kinds == _UNIT_WORD) & after_number)] = UNIT
    held[(kinds == _CAPITAL) & ~first] = NAME
    count = np.flatnonzero(kinds != _MARK)
    plain, held = numbers[count] >> np.uint64(4), held[count]
    return words, seen[count], plain, np.where(held > 0, _PLACES[held], plain), held, of[count]


def canonical(text: str, known: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a text and which of them count; of those, numbers, template, and placeholders.

    A number is a placeholder; so is a unit word after a number or a currency sign, and a
    capitalised word that does not begin a sentence.
    """
    return _canonical([text], known)[:5]


def _rolled(ids: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """The hash of every window, or of those at the given places."""
    total = np.zeros(len(ids) - width + 1 if at is None else len(at), np.uint64)
    for k in range(width):
        total *= np.uint64(_MIX[1] | 1)
        total += ids[k : len(ids) - width + 1 + k] if at is None else ids[at + k]
    total ^= total >> np.uint64(31)
    total *= np.uint64(_MIX[2])
    return total ^ (total >> np.uint64(29))


def windows(texts: list[str], widths: list[int], known: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Slots]]:
    """For each width: of every window, the text it is of, its place there and its hash; and what makes its slots.

    The texts are laid out one after another; a window lies within one of them.
    """
    words, at, plain, template, held, of = _canonical(texts, known)
    sizes = np.bincount(of, minlength=len(texts))
    begins = np.cumsum(sizes) - sizes
    counted = np.concatenate(([0], np.cumsum(held > 0)))
    for width in widths:
        if not width or len(plain) < width:
            continue
        inside = of[width - 1 :] == of[: len(of) - width + 1]
        if width < LEAST_WORDS:
            inside &= sizes[of[: len(inside)]] == width
        hashes = _rolled(template, width)
        mostly = np.flatnonzero(2 * (counted[width:] - counted[:-width]) > width)
        hashes[mostly] = _rolled(plain, width, mostly)
        hashes ^= np.uint64(width)
        starts = np.flatnonzero(inside)
        text = of[starts]
        yield width, text, starts - begins[text], hashes[starts], Slots(words, at, held, width, begins)


class Slots:
    """The values behind the placeholders of a window, by its text and place."""

    def __init__(self, words: list[str], at: np.ndarray, held: np.ndarray, width: int, begins: np.ndarray) -> None:
        self.words, self.at, self.held, self.width, self.begins = words, at, held, width, begins

    def __call__(self, text: int, place: int) -> list[str]:
        start = int(self.begins[text]) + place
        inside = [k for k in range(start, start + self.width) if self.held[k]]
        return [f"{self.held[k]}{next(t for t in _TOKEN.findall(self.words[self.at[k]])).lower()}" for k in inside]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, width, place, hash, slots and the item's number of windows."""
    items = narrow(benchmark, item_id="long", text="string")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"].astype("object"), batch["text"], strict=True):
                n = len(canonical(text or "", known)[1])
                for width, _, _, hashes, slots in windows([text or ""], [min(n, window)], known):
                    for at, h in enumerate(hashes.view(np.int64)):
                        rows.append((None if pd.isna(item) else int(item), width, at, int(h), slots(0, at), len(hashes)))
            yield pd.DataFrame(rows, columns=["item_id", "width", "place", "hash", "slots", "item_windows"]).astype({"item_id": "Int64"})

    schema = "item_id long, width int, place int, hash long, slots array<string>, item_windows int"
    return store(items.mapInPandas(cut, schema), "benchmark-windows")


def document_windows(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, key, width, place, hash and slots of the windows that may be in the benchmark."""
    # As many rows as there are widths: WINDOW at most.
    widths = sorted(r["width"] for r in bench.select("width").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(bench.select("hash"), FILTER_BITS))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap, bits = shared.value
        known = vocabulary()
        names = ["doc_id", "a", "b", "width", "place", "hash", "slots"]
        for batch in batches:
            rows = []
            docs, a, b = batch["doc_id"].astype("object").tolist(), batch["a"].tolist(), batch["b"].tolist()
            for start, block in _blocks(batch["text"]):
                for width, texts, places, hashes, slots in windows(block, widths, known):
                    may = np.flatnonzero(in_bitmap(hashes, bitmap, bits))
                    for text, at, h in zip(texts[may].tolist(), places[may].tolist(), hashes[may].view(np.int64).tolist(), strict=True):
                        row = start + text
                        rows.append((None if pd.isna(docs[row]) else int(docs[row]), a[row], b[row], width, at, h, slots(text, at)))
                        if len(rows) >= 20_000:
                            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                            rows = []
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    read = narrow(docs, doc_id="long", text="string").withColumn("key", row_key("doc_id", "text")).select("doc_id", "key.*", "text")
    return read.mapInPandas(search, "doc_id long, a long, b long, width int, place int, hash long, slots array<string>")


def _values_met(met: DataFrame, at: list[str]) -> DataFrame:
    """Values that stand for each other at one offset, each pair once."""
    return met.select(*at, F.explode(F.arrays_zip("slots", "item_slots")).alias("x")).select(*at, "x.*").distinct()


def _without_clashing_offsets(met: DataFrame, at: list[str]) -> DataFrame:
    each = _values_met(met, at)
    odd = [
        each.groupBy(*at, side).agg(F.count("*").alias("n")).where("n > 1").select(*at).distinct() for side in ("slots", "item_slots")
    ]
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"o.{c}")) for c in at]
    return met.alias("m").join(odd[0].union(odd[1]).alias("o"), same, "left_anti")


def _without_clashing_windows(met: DataFrame, at: list[str]) -> DataFrame:
    """Without the windows in which a value of the item is changed that is another one elsewhere at the offset."""
    odd = _values_met(met, at).groupBy(*at, "item_slots").agg(F.count("*").alias("n")).where("n > 1")
    # At most as many as the item has placeholders.
    odd = odd.groupBy(*at).agg(F.collect_set("item_slots").alias("odd"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"o.{c}")) for c in at]
    both = met.alias("m").join(odd.alias("o"), same, "left").select("m.*", "odd")
    clashes = F.exists(F.zip_with("slots", "item_slots", lambda x, y: (x != y) & F.array_contains("odd", y)), lambda x: x)
    return both.where(F.col("odd").isNull() | ~clashes).drop("odd")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, window: int = WINDOW, strict: bool = True
) -> DataFrame:
    """One row for each document and item that meet: doc_id, item_id, windows met, coverage, changed slots.

    ``strict`` drops all windows of an offset at which any values clash, word-for-word ones too.
    """
    small_batches(docs.sparkSession)
    bench = benchmark_windows(benchmark, window)
    found = document_windows(docs, bench)
    item = bench.select(
        "hash", "width", "item_id", "item_windows", F.col("place").alias("item_place"), F.col("slots").alias("item_slots")
    )
    met = found.join(item, ["hash", "width"]).where(F.size("slots") == F.size("item_slots"))
    pair = ["doc_id", "a", "b", "item_id"]
    met = store(met.select(*pair, "item_windows", (F.col("place") - F.col("item_place")).alias("offset"), "item_place", "slots", "item_slots"), "windows-met")
    fits = _without_clashing_offsets(met, [*pair, "offset"]) if strict else _without_clashing_windows(met, [*pair, "offset"])
    changed = F.exists(F.zip_with("slots", "item_slots", lambda x, y: x != y), lambda x: x)
    pairs = fits.groupBy(*pair).agg(
        F.count_distinct("item_place").alias("windows"), F.max("item_windows").alias("item_windows"), F.max(changed).alias("changed_slots")
    )
    share = F.col("windows") / F.col("item_windows")
    return pairs.withColumn("coverage", share).where(share >= coverage).select(
        "doc_id", "item_id", F.col("windows").cast("long").alias("windows"), "coverage", "changed_slots", "a", "b"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    bad = store(contaminated(docs, benchmark, **options).select(F.struct("a", "b").alias("key_")).distinct(), "contaminated")
    names = [F.col(f"`{n}`") for n in docs.columns]
    keyed = docs.withColumn("key_", row_key("doc_id", "text"))
    return keyed.join(bad, "key_", "left_anti").select(*names)
