"""Running maxima along an ordered group, in pieces.

A plain window sorts a whole group in one task. Here a group is cut into chunks of the
order (for example hours of arrival): each chunk is scanned on its own, and the maximum
of the chunks before it, pre-aggregated to one row per chunk, is joined in. The result
is the same, and a group that holds a large share of all rows is spread over tasks.

``lag`` is a running maximum too: the largest (order, value) before the current row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def running_max(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: str,
    before: dict[str, Column] | None = None,
    upto: dict[str, Column] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add running maxima per ``keys``; NULLs do not count.

    ``before`` holds maxima over the rows ahead of the current one, ``upto`` those that
    include it. ``chunk`` names a column that never decreases along ``order``; it and
    ``keys`` must not be NULL. A second scan over the same chunk column finds its input
    partitioned already, so a chain of scans moves the rows once.
    """
    before, upto = before or {}, upto or {}
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    piece = Window.partitionBy(*keys, chunk).orderBy(*[direction(c) for c in order])
    values = {**before, **upto}

    scanned = rows.select(
        "*",
        *[F.max(v).over(piece.rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n, v in before.items()],
        *[F.max(v).over(piece.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n, v in upto.items()],
    )
    totals = rows.groupBy(*keys, chunk).agg(*[F.max(v).alias(f"_t_{n}") for n, v in values.items()])
    chunks_before = Window.partitionBy(*keys).orderBy(direction(chunk)).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_c_{k}") for k in (*keys, chunk)],
        *[F.max(f"_t_{n}").over(chunks_before).alias(f"_c_{n}") for n in values],
    )
    same_piece = reduce(lambda a, b: a & b, [scanned[k] == carried[f"_c_{k}"] for k in (*keys, chunk)])
    return scanned.join(carried, same_piece).select(
        *rows.columns, *[F.greatest(F.col(n), F.col(f"_c_{n}")).alias(n) for n in values]
    )
