"""Shards of equal bytes by histogram sort.

Every row has a key of three numbers: a hash of its text, one of the whole row, and one of its
place, which tells rows apart that are equal throughout. Cuts of the key space are found
without moving a row: a round counts the exact bytes between probes in all partitions, and
puts new probes into the intervals that hold a wanted boundary and are not yet narrow enough.
A boundary is settled when the bytes below it are within ``tolerance`` of their target, or
when no more than one row lies in its interval; then the nearer side is taken. Probes divide
hashes of texts first, and rows of one text only when that text alone is too large, so equal
texts stay in one shard unless they outweigh twice the tolerance.

The same counts give pieces of about ``piece_bytes`` inside the shards. One exchange then
brings each piece to a task, which sorts it by key; the shards are written as files, a folder
for each, and slots are numbered from the rows counted in the files. A text that holds a third
of all rows is many pieces, and no task gets more than a few pieces.

The driver holds probes and their counts: at most ``PROBES`` a round, and one cut a piece.

Cases: a missing text has no bytes and counts as an empty one; repeated rows each keep a slot,
and copies of a row are told apart by their place in the scan, so what is no scan of files
should be stored before; an empty table gives no rows; a row that is larger than a shard's
share leaves neighbouring shards smaller or empty; the columns of the table, whatever their
names, come back inside ``row``.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetledger.llm.common import column_or_null, store
from meetledger.session import fresh_path

SHARDS = 40
TOLERANCE = 0.001  # of the bytes of a shard
PROBES = 4_096  # new probes a round
PIECE_BYTES = 256 << 20
ROW_BYTES = 16  # beside the text
_WORD = 64
_KEY = ["h", "t", "u"]
_SPACE = 1 << (_WORD * len(_KEY))


def keyed(docs: DataFrame) -> DataFrame:
    """``row`` with all columns, ``size``, and the key."""
    plain = [f.name for f in docs.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    text = F.coalesce(column_or_null(docs, "text", "string"), F.lit(""))
    return docs.select(
        F.struct("*").alias("row"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(*[part for name in plain for part in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]).alias("t"),
        F.xxhash64(F.monotonically_increasing_id()).alias("u"),
    )


def _as_words(cuts: list[int]) -> np.ndarray:
    """Cuts as rows of signed numbers, which compare like the key's columns."""
    half, mask = 1 << (_WORD - 1), (1 << _WORD) - 1
    shifts = [_WORD * k for k in reversed(range(len(_KEY)))]
    return np.array([[(c >> s & mask) - half for s in shifts] for c in cuts], np.int64).reshape(-1, len(_KEY))


def cuts_up_to(columns: list[np.ndarray], cuts: np.ndarray) -> np.ndarray:
    """How many of the sorted cuts are not above each key."""
    low = np.searchsorted(cuts[:, 0], columns[0], "left")
    high = np.searchsorted(cuts[:, 0], columns[0], "right")
    if len(columns) > 1:
        tied = np.flatnonzero(low < high)
        tied = tied[np.argsort(low[tied], kind="stable")]
        for rows in np.split(tied, np.flatnonzero(np.diff(low[tied])) + 1) if len(tied) else []:
            inner = cuts[low[rows[0]] : high[rows[0]], 1:]
            high[rows] = low[rows] + cuts_up_to([c[rows] for c in columns[1:]], inner)
    return high


def histogram(keys: DataFrame, cuts: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows between neighbouring cuts, ends included; summed where the rows are."""
    words = _as_words(cuts)

    def count(batches):
        size, rows = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64)
        for batch in batches:
            cell = cuts_up_to([batch.column(k).to_numpy() for k in range(len(_KEY))], words)
            size += np.bincount(cell, batch.column(len(_KEY)).to_numpy(), len(size)).astype(np.int64)
            rows += np.bincount(cell, minlength=len(rows))
        cell = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(size[cell]), pa.array(rows[cell])], ["cell", "size", "rows"])

    found = keys.select(*_KEY, "size").mapInArrow(count, "cell long, size long, rows long")
    found = found.groupBy("cell").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).toArrow().to_pydict()
    size, rows = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for cell, s, r in zip(found["cell"], found["size"], found["rows"]):
        size[cell], rows[cell] = s, r
    return size, rows


def _unit(low: int, high: int) -> int:
    """The coarsest part of the key that still varies in an interval."""
    return max(1 << shift for shift in (2 * _WORD, _WORD, 0) if high - low > 1 << shift or not shift)


def _grid(low: int, high: int, probes: int) -> list[int]:
    unit = _unit(low, high)
    points = {(low + (high - low) * k // (probes + 1)) // unit * unit for k in range(1, probes + 1)}
    return sorted(p for p in points if low < p < high)


def _level(cut: int) -> int:
    """0 for a boundary between texts, 1 inside a text, 2 between equal rows."""
    return 0 if cut % (1 << 2 * _WORD) == 0 else 1 if cut % (1 << _WORD) == 0 else 2


class Cuts:
    """What is known of the key space: cuts, and the exact bytes and rows below each."""

    def __init__(self, keys: DataFrame, probes: int) -> None:
        self.keys, self.probes = keys, probes
        self.at, self.bytes, self.rows = [0], [0], [0]
        grid = _grid(0, _SPACE, probes)
        size, rows = histogram(keys, grid)
        for cut, s, r in zip([*grid, _SPACE], size, rows):
            self._add(cut, s, r)

    def _add(self, cut: int, size: int, rows: int) -> None:
        self.at.append(cut)
        self.bytes.append(self.bytes[-1] + size)
        self.rows.append(self.rows[-1] + rows)

    def divisible(self, k: int) -> bool:
        return self.rows[k + 1] - self.rows[k] > 1 and self.at[k + 1] - self.at[k] > 1

    def open_for(self, targets: list[float], margin: float) -> list[int]:
        """Intervals that hold a target farther than ``margin`` from both of their ends."""
        found = set()
        for target in targets:
            k = bisect_left(self.bytes, target) - 1
            if 0 <= k and target - self.bytes[k] > margin and self.bytes[k + 1] - target > margin and self.divisible(k):
                found.add(k)
        return sorted(found)

    def above(self, size: float) -> list[int]:
        return [k for k in range(len(self.at) - 1) if self.bytes[k + 1] - self.bytes[k] > size and self.divisible(k)]

    def refine(self, wanted: dict[int, int]) -> None:
        """Count ``wanted[k]`` new probes inside each interval ``k``."""
        grids = {k: _grid(self.at[k], self.at[k + 1], n) for k, n in sorted(wanted.items())}
        edges = sorted({c for k, grid in grids.items() for c in (self.at[k], *grid, self.at[k + 1])})
        size, rows = histogram(self.keys, edges)
        number = {c: i for i, c in enumerate(edges)}
        old = list(zip(self.at, self.bytes, self.rows))
        self.at, self.bytes, self.rows = [], [], []
        for k, (cut, s, r) in enumerate(old):
            self.at.append(cut), self.bytes.append(s), self.rows.append(r)
            for before, probe in zip([cut, *grids.get(k, [])], grids.get(k, [])):
                self._add(probe, size[number[before] + 1], rows[number[before] + 1])

    def nearest(self, target: float, margin: float) -> int:
        """The cut whose bytes below are nearest; of those within the margin, one between texts."""
        k = bisect_left(self.bytes, target)
        # Cuts with nothing between them are equal in bytes: look at all that lie within the margin.
        first, last = bisect_left(self.bytes, target - margin), bisect_left(self.bytes, target + margin)
        near = [i for i in range(max(0, min(first, k - 1)), min(len(self.at), max(last, k) + 1))]
        away = lambda i: abs(self.bytes[i] - target)
        within = [i for i in near if away(i) <= margin]
        best = min(within, key=lambda i: (_level(self.at[i]), away(i), i)) if within else min(near, key=lambda i: (away(i), i))
        return self.at[best]


def find_cuts(keys: DataFrame, shards: int, tolerance: float, piece_bytes: int, probes: int = PROBES) -> tuple[list[int], list[int]]:
    """The boundaries of the shards, and all boundaries of pieces, those of shards included."""
    cuts = Cuts(keys, probes)
    total = cuts.bytes[-1]
    margin = tolerance * total / shards
    targets = [total * k / shards for k in range(1, shards)]
    while True:
        wanted = {k: -(-(cuts.bytes[k + 1] - cuts.bytes[k]) // piece_bytes) for k in cuts.above(2 * piece_bytes)}
        undecided = cuts.open_for(targets, margin)
        for k in undecided:
            wanted[k] = max(wanted.get(k, 1), probes // len(undecided), 1)
        if not wanted:
            break
        cuts.refine(wanted)
    bounds = [cuts.nearest(target, margin) for target in targets] if total else []
    pieces, held = sorted(set(bounds)), 0
    fixed = set(pieces)
    for k in range(1, len(cuts.at) - 1):
        held += cuts.bytes[k] - cuts.bytes[k - 1]
        if cuts.at[k] in fixed:
            held = 0
        elif held + cuts.bytes[k + 1] - cuts.bytes[k] > piece_bytes:
            pieces.append(cuts.at[k])
            held = 0
    return bounds, sorted(pieces)


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, piece_bytes: int = PIECE_BYTES, probes: int = PROBES) -> DataFrame:
    """row (all columns of ``docs``), size, shard and slot, read from the written shards.

    Shards are ranges of the key and differ in bytes by the tolerance, or by the row that
    lies on a boundary; slots number the rows of a shard from 0 in the order of the key.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    bounds, pieces = find_cuts(store(rows.select(*_KEY, "size"), "sort-keys"), shards, tolerance, piece_bytes, probes)
    words = _as_words(pieces)
    # A boundary may be the end of several shards, when those between are empty.
    owner = np.searchsorted(np.array(bounds, object), np.array([0, *pieces], object), "right").astype(np.int64)

    @F.pandas_udf("long")
    def piece_of(h: pd.Series, t: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(cuts_up_to([h.to_numpy(), t.to_numpy(), u.to_numpy()], words) if len(words) else np.zeros(len(h), np.int64))

    @F.pandas_udf("int")
    def shard_of(piece: pd.Series) -> pd.Series:
        return pd.Series(owner[piece.to_numpy()])

    in_piece = Window.partitionBy("piece").orderBy(*_KEY)
    placed = rows.withColumn("piece", piece_of(*_KEY)).withColumn("place", F.row_number().over(in_piece) - 1)
    placed = placed.select("row", "size", "piece", F.col("place").cast("long").alias("place"), shard_of("piece").alias("shard"))
    path = fresh_path(spark, "llm-shards")
    placed.write.partitionBy("shard").parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    # One row a piece; a shard has as many as its bytes ask for.
    counted = stored.groupBy("shard", "piece").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "piece", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    return stored.join(starts, ["shard", "piece"]).select("row", "size", "shard", (F.col("start") + F.col("place")).alias("slot"))
