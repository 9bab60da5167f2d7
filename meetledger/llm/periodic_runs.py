"""Periodic runs of words, by uniting suffix classes in order of decreasing common prefix.

A run is a stretch of words with smallest period q that is at least ``max(least, 2q)`` words
long and cannot be extended. The suffixes of a stretch of text are sorted by prefix doubling,
with the length of the common prefix of neighbours. Neighbours are united from the longest
common prefix down: union-find, each class with its positions in order, the smaller class put
into the larger. Two positions i < j that become neighbours in a class at length l have
exactly l words in common; if j - i is no more than l, words i to j + l have period j - i. It
is the start of a run if the words before i and j differ. A multiple of the smallest period
gives the same start and end, so of these the least period is kept.

Common prefixes below ``least / 2`` words can give no run. So only places whose window of that
many words occurs twice in the text are looked at, and they cut it into stretches: within a
run such places are never farther apart than the window. Most texts have none. Texts are
independent rows; Arrow batches of bounded size go through ``mapInArrow``, nothing is shuffled.

Cases: a missing or empty text has no words, no run and an empty collapsed text; a long text
is one task's work, its stretches one by one, in time n log n; repeated rows get equal
results; a missing id is kept; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetledger.llm.common import narrow, small_batches, words

LEAST = 12  # words of a run
_WORD = re.compile(r"[^ \t-\r]+")
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the words that each has in common with the next."""
    n = len(ids)
    ranks, width = [np.unique(ids, return_inverse=True)[1]], 1
    while ranks[-1].max() + 1 < n:
        here = ranks[-1]
        beyond = np.zeros(n, np.int64)
        beyond[: max(n - width, 0)] = here[width:] + 1
        ranks.append(np.unique(here * (n + 1) + beyond, return_inverse=True)[1])
        width *= 2
    order = np.argsort(ranks[-1])
    left, right, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for level in reversed(range(len(ranks))):
        padded = np.append(ranks[level], -1)
        same = padded[left] == padded[right]
        step = same.astype(np.int64) << level
        common += step
        left, right = np.minimum(left + step, n), np.minimum(right + step, n)
    return order, common


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    if len(ids) < least:
        return []
    order, common = suffix_order(ids)
    shortest = (least + 1) // 2
    steps = np.flatnonzero(common >= shortest)
    steps = steps[np.argsort(-common[steps], kind="stable")]
    position, word = order.tolist(), ids.tolist()
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found: dict[tuple[int, int], int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def meet(i: int, j: int, shared: int) -> None:
        period = j - i
        if period <= shared and period + shared >= least and (i == 0 or word[i - 1] != word[j - 1]):
            run = (i, period + shared)
            found[run] = min(period, found.get(run, period))

    for step, shared in zip(steps.tolist(), common[steps].tolist()):
        a, b = root(step), root(step + 1)
        large, small = members.pop(a, None) or [position[a]], members.pop(b, None) or [position[b]]
        if len(large) < len(small):
            large, small = small, large
        parent[a] = b
        for k, x in enumerate(small):
            at = bisect_left(large, x)
            if at and (k == 0 or small[k - 1] < large[at - 1]):
                meet(large[at - 1], x, shared)
            if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
                meet(x, large[at], shared)
        if len(small) < 8:
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()  # two ordered runs, merged in linear time
        members[b] = large
    return sorted(((start, length, period) for (start, length), period in found.items()), key=lambda r: (r[0], r[2]))


def _windows(ids: np.ndarray, text_no: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose window of ``width`` words lies in one text and occurs in it again."""
    n = len(ids) - width + 1
    if n < 2:
        return np.empty(0, np.int64), text_no[:0]
    inside = text_no[:n] == text_no[width - 1 :]
    mixed = text_no[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        mixed = (mixed ^ ids[k : n + k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    at = np.flatnonzero(inside)
    at = at[np.argsort(mixed[at], kind="stable")]
    same = mixed[at[1:]] == mixed[at[:-1]]
    repeated = np.zeros(len(at), bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    places = np.sort(at[repeated])
    return places, text_no[places]


def stretches(places: np.ndarray, text_no: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(text number, begin, end) of the stretches that can hold a run."""
    if not len(places):
        return []
    cut = np.flatnonzero((np.diff(places) > width) | (np.diff(text_no) != 0)) + 1
    first, last = np.append(0, cut), np.append(cut, len(places)) - 1
    return list(zip(text_no[first].tolist(), places[first].tolist(), (places[last] + width).tolist()))


def runs_of_texts(texts: list[str | None], least: int = LEAST) -> tuple[list[list[str]], list[list[tuple[int, int, int]]]]:
    """Words and runs of each text; texts are looked at together, their runs one by one."""
    split = [_WORD.findall(text or "") for text in texts]
    number = defaultdict(count().__next__)
    ids = np.array([number[w] for ws in split for w in ws], np.int64)
    sizes = np.array([len(ws) for ws in split], np.int64)
    begins = np.cumsum(sizes) - sizes
    text_no = np.repeat(np.arange(len(texts)), sizes)
    width = (least + 1) // 2
    places, owners = _windows(ids, text_no, width)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for no, begin, end in stretches(places, owners, width):
        offset = begin - int(begins[no])
        runs[no] += [(start + offset, length, period) for start, length, period in find_runs(ids[begin:end], least)]
    return split, runs


def collapsed(text_words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return " ".join(text_words)
    edges = np.zeros(len(text_words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return " ".join(w for w, depth in zip(text_words, np.cumsum(edges).tolist()) if not depth)


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and text without repetitions."""
    small_batches(docs.sparkSession)

    def every(batches):
        for batch in batches:
            split, runs = runs_of_texts(batch.column(1).to_pylist(), least)
            spans = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(ws) for ws in split], pa.int64()),
                    pa.array(spans, pa.list_(_ARROW_RUN)),
                    pa.array([collapsed(ws, found) for ws, found in zip(split, runs)], pa.string()),
                ],
                ["doc_id", "n_words", "runs", "text"],
            )

    return narrow(docs, doc_id="long", text="string").mapInArrow(every, f"doc_id long, n_words long, runs {_RUNS}, text string")


def plant(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document, by a hash of its id, repeats a stretch up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = narrow(docs, doc_id="long", text="string").withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    split = chosen.withColumn("w", F.when(F.col("g").isNotNull(), words(F.col("text")))).withColumn("n", F.size("w"))
    begin = split.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    period = begin.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    repeated = F.transform(F.sequence("a", F.col("n") - 1), lambda i: F.element_at("w", F.col("a") + (i - F.col("a")) % F.col("p") + 1))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), repeated), " ")
    return period.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = found.withColumn("best", longest)
    length, start, period = F.col("best.length"), -F.col("best.start"), -F.col("best.period")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
        "n_words",
    )
