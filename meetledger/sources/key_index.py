"""What a stored log claims: idempotency keys, contents and event ids, found by bucket.

Each stored row is filed under its claims in a bucketed table. A claim is 128 bits of a
hash, so that an entry is a few numbers and sorts as such; beside a stored log it is nothing else. A few claims are looked up in
their buckets, so a small batch does not read what it does not touch, however long the
log has become; the claims of a large batch meet all stored ones in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetledger.operators.dedup import _ORDER, CONTENT_KEY, fingerprint, has_key, place
from meetledger.sources.tables import Commit, TableStore

TABLE = "log_claims"
# what the duplicate rules need of a stored row
KEY_COLUMNS = ["event_id", "idempotency_key", *CONTENT_KEY, "received_at"]
_KEY, _CONTENT, _ID = "k", "c", "i"
_CLAIM = ["claim", "check"]


def _exposed() -> Column:
    """A row that a copy of its content makes a duplicate."""
    return ~has_key() & F.col("booking_id").isNotNull()


def claims(rows: DataFrame, *others: Column, kinds: str = _ID + _KEY + _CONTENT) -> DataFrame:
    """One row for each claim of a row: its key, its content if it has a booking, its id.

    ``asks``: the row is a duplicate or a conflict if another one holds the claim.
    """
    held = {
        _ID: (F.col("event_id").isNotNull(), F.lit(True), ["event_id"]),
        _KEY: (has_key(), F.lit(True), ["idempotency_key"]),
        _CONTENT: (F.col("booking_id").isNotNull(), _exposed(), CONTENT_KEY),
    }
    entries = []
    for kind in kinds:
        holds, asks, columns = held[kind]
        claim, check = fingerprint(columns, kind)
        entries.append(F.when(holds, F.struct(F.lit(kind).alias("kind"), claim.alias("claim"), check.alias("check"), asks.alias("asks"))))
    return rows.select(*others, F.inline(F.array(*entries))).filter(F.col("kind").isNotNull())


class KeyIndex:
    def __init__(self, store: TableStore, table: str = TABLE, log: str | None = None) -> None:
        """``log`` names the table of the same store that holds the filed rows, if one does.

        The index is then claims alone, and what the rules need of a row is not kept twice.
        """
        self.store, self.table, self.log = store, table, log

    def add(self, commit: Commit, log: DataFrame) -> None:
        """File the rows; what the rules need of a row lies in the log, or with its id, which its other claims name."""
        if self.log:
            commit.append(self.table, claims(log).select("kind", *_CLAIM), bucket_by=["claim"])
            return
        filed = claims(log, *[F.col(c) for c in KEY_COLUMNS])
        entry = filed.select(
            "kind",
            *_CLAIM,
            fingerprint(["event_id"], _ID)[0].alias("id_claim"),
            fingerprint(KEY_COLUMNS)[0].alias("row"),
            F.when(F.col("kind") == _ID, F.struct(*KEY_COLUMNS)).alias("columns"),
        )
        commit.append(self.table, entry, bucket_by=["claim"])

    def sharing(self, rows: DataFrame) -> DataFrame | None:
        """The stored rows that share a claim with one of ``rows``; None before anything is stored."""
        asked = claims(rows).select(*_CLAIM)
        found = self.store.lookup(self.table, asked)
        if found is None:
            return None
        if self.log:
            held = claims(self.store.read(self.log), F.struct(*KEY_COLUMNS).alias("columns"))
            return held.join(asked, _CLAIM, "left_semi").select("columns.*").distinct()
        hits = found.join(asked, _CLAIM, "left_semi").select(F.col("id_claim").alias("claim"), "row")
        by_id = self.store.lookup(self.table, hits).filter(F.col("kind") == _ID)
        return by_id.join(hits, ["claim", "row"], "left_semi").select("columns.*").distinct()

    def contested(self, rows: DataFrame) -> DataFrame:
        """Rule columns of the rows that share a claim with another row of the batch or a stored one.

        ``_by_key``, ``_by_content`` and ``_by_id`` name the claims by which a row meets a stored one.
        """
        # contents matter only where a row without a key may be a copy
        kinds = _ID + _KEY + ("" if rows.filter(_exposed()).isEmpty() else _CONTENT)
        own = claims(rows, *place(), kinds=kinds)
        met = own.select(*_CLAIM, "asks", F.lit(1).alias("rows"), F.lit(False).alias("stored"))
        few = self.store.by_value(self.table, own.filter("asks").select("claim"))
        known = self.store.read(self.table) if few is None else few
        if known is not None:
            held = known.filter(F.col("kind").isin(*kinds)).select(*_CLAIM, F.lit(False).alias("asks"), F.lit(0).alias("rows"), F.lit(True).alias("stored"))
            met = met.unionByName(held)
        shared = met.groupBy(*_CLAIM).agg(F.max("asks").alias("asks"), F.sum("rows").alias("rows"), F.max("stored").alias("stored"))
        shared = shared.filter(F.col("asks") & (F.col("stored") | (F.col("rows") > 1))).select(*_CLAIM, "stored")
        by = lambda kind: F.max(F.col("stored") & F.col("asks") & (F.col("kind") == kind))
        hits = own.join(shared, _CLAIM).groupBy("_row", "_check").agg(
            by(_KEY).alias("_by_key"), by(_CONTENT).alias("_by_content"), by(_ID).alias("_by_id")
        )
        return rows.select(*_ORDER, *place()).join(hits, ["_row", "_check"]).drop("_row", "_check")
