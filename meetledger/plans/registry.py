"""User-defined projections.

A projection names the events it takes (a predicate over the log) and how to build its
table from them. It is run by the pipeline beside the built-in ones. One that is a fold can
also be kept by a stream: each batch appends what it says alone, and the partial results are
merged on read, or held as stream state.
"""

from __future__ import annotations

import logging

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from meetledger.operators.folds import Fold


@dataclass(frozen=True)
class Context:
    """What a builder may join with."""

    log: DataFrame
    facts: DataFrame
    participants: DataFrame
    bookings: DataFrame


@dataclass(frozen=True)
class Projection:
    name: str
    predicate: Column
    build: Callable[[DataFrame, Context], DataFrame]
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class FoldedProjection:
    """A table with one row per key of ``fold``, over columns of the log (or what ``rows`` makes of them).

    ``rows`` has to work row by row, as a stream shows it one batch at a time; what the fold
    makes of a key must not depend on how the log was cut, which its maxima and minima do not.
    """

    name: str
    predicate: Column
    fold: Fold
    rows: Callable[[DataFrame], DataFrame] = lambda log: log

    @property
    def stored_name(self) -> str:
        return f"custom_{self.name}"

    def partial(self, log: DataFrame) -> DataFrame:
        return self.fold.partial(self.rows(log.filter(self.predicate)))

    def build(self, rows: DataFrame, context: Context) -> DataFrame:
        return self.fold(self.rows(rows))


@dataclass
class Registry:
    projections: list[Projection | FoldedProjection] = field(default_factory=list)
    failures: dict[str, Exception] = field(default_factory=dict)

    def register(self, projection: Projection | FoldedProjection) -> Projection | FoldedProjection:
        if any(p.name == projection.name for p in self.projections):
            raise ValueError(f"projection {projection.name} is registered already")
        self.projections.append(projection)
        return projection

    @property
    def folded(self) -> dict[str, FoldedProjection]:
        """The projections that a stream can keep, by the name of their stored partials."""
        return {p.stored_name: p for p in self.projections if isinstance(p, FoldedProjection)}

    def partials(self, log: DataFrame) -> dict[str, DataFrame]:
        """What a batch says on each folded table. One that cannot be built is logged and left out."""
        return self._each(self.folded, lambda p: p.partial(log))

    def run(self, context: Context) -> dict[str, DataFrame]:
        """The table of every projection. One that cannot be built is logged and left out; the others go on."""
        return self._each({p.name: p for p in self.projections}, lambda p: p.build(context.log.filter(p.predicate), context))

    def _each(self, named: dict, build: Callable[..., DataFrame]) -> dict[str, DataFrame]:
        tables: dict[str, DataFrame] = {}
        self.failures = {}
        for name, projection in named.items():
            try:
                tables[name] = build(projection)
            except Exception as error:
                logging.getLogger(__name__).exception("projection %s failed", projection.name)
                self.failures[projection.name] = error
        return tables
