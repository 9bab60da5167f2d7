"""Words, row keys and column choice shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meetledger.session import materialize

WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space; none for a missing text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_CLASS, -1))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The named column in the given type, or nulls where the frame has none."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def narrow(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns; whatever else the frame has, under whatever name, is left behind."""
    return df.select(*[column_or_null(df, name, kind) for name, kind in kinds.items()])


def row_key(*names: str) -> Column:
    """128 bits that tell rows apart by the named columns; nulls count as a value of their own."""
    parts = [part for n in names for part in (F.col(n).isNull(), F.col(n))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *parts).alias("b"))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and go on from there."""
    return materialize(df, f"llm-{name}")


def small_batches(spark, rows: int = 1_000, size: str = "8m") -> None:
    """Rows and bytes that a Python worker gets at once; whole texts are wide rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


_KEPT: dict[Hashable, Any] = {}


def kept(name: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task. It is one thing at a time: a worker serves one operator after another."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def bitmap_of(hashes: DataFrame, bits_range: tuple[int, int], spare: int = 64) -> tuple[np.ndarray, int]:
    """A bitmap of the column ``hash`` by its leading bits.

    Places grow with the number of rows (``spare`` for each), within the range of bits; a
    fuller bitmap lets more through and never holds back what it should let through.
    """
    n = hashes.count()
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) * spare)), *bits_range))
    place = F.shiftrightunsigned("hash", 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1), F.pmod(place, F.lit(8)).cast("int"))
    # At most 2**(bits - 3) rows, however many hashes there are.
    filled = hashes.select(F.shiftright(place, 3).alias("byte"), bit.alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("value")).toArrow()
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    bitmap[filled["byte"].to_numpy()] = filled["value"].to_numpy()
    return bitmap, bits


def in_bitmap(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    place = hashes.view(np.uint64) >> np.uint64(64 - bits)
    byte = bitmap[(place >> np.uint64(3)).astype(np.int64)]
    return (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
