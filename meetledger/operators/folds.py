"""Keyed folds: upserts, one row at a time in arrival order, seen as aggregates.

Every column of a fold is a ``max`` or ``min`` over (arrival, value), so a fold is
pre-aggregated before its shuffle, and the partial results of several runs can be
merged by the same aggregate. A stream stores one partial per batch and merges on read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetledger.operators.lookup import seq


def latest(value: Column, when: Column | None = None, order: Column | None = None) -> tuple[str, Column]:
    """Value of the last row; a NULL counts and erases what was there."""
    pair = F.struct((order if order is not None else seq()).alias("at"), value.alias("value"))
    return "max", pair if when is None else F.when(when, pair)


def latest_known(value: Column, when: Column | None = None, order: Column | None = None) -> tuple[str, Column]:
    """Value of the last row that has one; a NULL keeps what was there."""
    known = value.isNotNull()
    return latest(value, known if when is None else known & when, order)


def first(value: Column, order: Column | None = None) -> tuple[str, Column]:
    return "min", F.struct((order if order is not None else seq()).alias("at"), value.alias("value"))


def greatest(value: Column, when: Column | None = None) -> tuple[str, Column]:
    """The largest value, whatever its arrival."""
    return "max", F.struct((value if when is None else F.when(when, value)).alias("value"))


@dataclass(frozen=True)
class Fold:
    """``keys``: columns that identify a row; ``columns``: what is folded for each key."""

    keys: Sequence[str]
    columns: dict[str, tuple[str, Column]]
    finish: Callable[[DataFrame], DataFrame] | None = field(default=None)

    def partial(self, rows: DataFrame) -> DataFrame:
        return self._aggregate(rows, {name: value for name, (_, value) in self.columns.items()})

    def merge(self, partials: DataFrame) -> DataFrame:
        return self._aggregate(partials, {name: F.col(name) for name in self.columns})

    def _aggregate(self, rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        how = {"max": F.max, "min": F.min}
        return rows.groupBy(*self.keys).agg(*[how[self.columns[n][0]](v).alias(n) for n, v in values.items()])

    def result(self, partials: DataFrame) -> DataFrame:
        """Plain columns from merged partials."""
        plain = partials.select(*self.keys, *[F.col(n)["value"].alias(n) for n in self.columns])
        return self.finish(plain) if self.finish else plain

    def __call__(self, rows: DataFrame) -> DataFrame:
        return self.result(self.partial(rows))
