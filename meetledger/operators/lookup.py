"""Key lookups that survive hot and missing keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetledger.schemas import SEQ


def seq(prefix: str = "") -> Column:
    """Arrival order of a row as one comparable value."""
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in SEQ])


def left_lookup(rows: DataFrame, table: DataFrame, key: str, table_key: str, scatter: str) -> DataFrame:
    """Left join to a table that is unique on ``table_key``.

    Rows without a key would all land in one partition; they are spread by the
    ``scatter`` column instead and match nothing. A hot key keeps one table row, so the
    adaptive skew join can split its side of ``rows``.
    """
    spread = rows.withColumn("_k", F.coalesce(key, F.lit(""))).withColumn(
        "_spread", F.when(F.col(key).isNull(), F.xxhash64(scatter)).otherwise(F.lit(0))
    )
    right = table.withColumnRenamed(table_key, "_k").withColumn("_spread", F.lit(0).cast("bigint"))
    return spread.join(right, ["_k", "_spread"], "left").drop("_k", "_spread")


def known_email(rows: DataFrame, email: str, participants: DataFrame, output: str) -> DataFrame:
    """``output`` = the email when a participant of that name existed as the row arrived.

    ``participants`` has ``email`` and ``first_seq``.
    """
    table = participants.select(F.col("email").alias("_email"), F.col("first_seq").alias("_first"))
    return (
        left_lookup(rows, table, email, "_email", "event_id")
        .withColumn(output, F.when(F.col("_first") <= seq(), F.col(email)))
        .drop("_first")
    )
