"""Deduplication of the event log.

Arrival order decides, the first row stays. An event with an idempotency key is
compared by that key alone; one without by (booking, type, source, payload hash). A
missing booking equals nothing, so such rows all stay.

Each rule is a ``row_number() = 1`` filter: Spark turns it into a group limit that
cuts every group to one row per input partition before the shuffle, so a group of
copies of any size moves as a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from meetledger.operators.lookup import seq

CONTENT_KEY = ["booking_id", "event_type", "source", "payload_hash"]
# arrival order, with ties between copies of one message settled by their content
_ORDER = ["received_at", "event_id", "payload_hash", "event_type", "source", "booking_id", "idempotency_key", "queue"]


def has_key() -> Column:
    return F.coalesce(F.col("idempotency_key"), F.lit("")) != ""


def _first_per(rows: DataFrame, group: list[Column]) -> DataFrame:
    order = [F.col(c) for c in _ORDER if c in rows.columns]
    names = [f"_g{i}" for i in range(len(group))]
    marked = rows.select("*", *[g.alias(n) for g, n in zip(group, names)])
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return marked.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", *names)


def _own_group_when(condition: Column) -> Column:
    """A value that sets a row apart from all others, so that nothing equals it."""
    return F.when(condition, F.struct("received_at", "event_id"))


def dedup_by_key(rows: DataFrame) -> DataFrame:
    """First row per idempotency key; rows without a key all stay."""
    return _first_per(rows, [F.when(has_key(), F.col("idempotency_key")), _own_group_when(~has_key())])


def dedup_by_content(rows: DataFrame) -> DataFrame:
    """First row per content key; rows without a booking all stay."""
    return _first_per(rows, [*[F.col(c) for c in CONTENT_KEY], _own_group_when(F.col("booking_id").isNull())])


def dedup_history(rows: DataFrame) -> DataFrame:
    """Clean-up of an old log: first row per content key, missing bookings being equal."""
    return _first_per(rows, [F.col(c) for c in CONTENT_KEY])


def deduplicate(rows: DataFrame, legacy_scope: str = "all") -> DataFrame:
    """Both rules at once, for one batch.

    A keyed row also blocks later keyless rows of the same content, unless
    ``legacy_scope="unkeyed"`` limits the content rule to rows without a key.
    """
    keyless = ~has_key()
    firsts = _first_per(
        rows,
        [
            F.when(has_key(), F.col("idempotency_key")),
            *[F.when(keyless, F.col(c)) for c in CONTENT_KEY],
            _own_group_when(keyless & F.col("booking_id").isNull()),
        ],
    )
    if legacy_scope == "unkeyed":
        return firsts
    return drop_blocked(firsts, firsts.filter(has_key()), earlier_only=True)


def drop_blocked(rows: DataFrame, stored: DataFrame, earlier_only: bool = False) -> DataFrame:
    """Without the keyless rows whose content ``stored`` already holds.

    Rows the rule cannot drop are spread by their own id in the join.
    """
    blockers = (
        stored.filter(F.col("booking_id").isNotNull())
        .groupBy(*CONTENT_KEY)
        .agg(F.min("received_at").alias("_b_at"), F.min(seq()).alias("_b_seq"))
        .select(*[F.col(c).alias(f"_b_{c}") for c in CONTENT_KEY], F.lit(0).cast("bigint").alias("_b_spread"), "_b_seq")
    )
    exposed = ~has_key() & F.col("booking_id").isNotNull()
    marked = rows.withColumn("_spread", F.when(exposed, F.lit(0)).otherwise(F.xxhash64("event_id", "received_at")))
    match = [marked[c] == blockers[f"_b_{c}"] for c in CONTENT_KEY]
    match += [marked["_spread"] == blockers["_b_spread"], exposed]
    if earlier_only:
        match.append(blockers["_b_seq"] < seq())
    condition = match[0]
    for term in match[1:]:
        condition = condition & term
    return marked.join(blockers, condition, "left_anti").drop("_spread")


def drop_stored(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Incremental run: without the rows a stored log already holds, by either rule.

    Only the stored keys that occur in ``rows`` are looked up. A small batch is sent to
    the stored keys by Spark's own size check, so the stored log is scanned in place.
    """
    new_keys = rows.filter(has_key()).select("idempotency_key").distinct()
    seen_keys = (
        stored.filter(has_key()).select("idempotency_key").join(new_keys, "idempotency_key", "left_semi").distinct()
        .select(F.col("idempotency_key").alias("_seen_key"), F.lit(0).cast("bigint").alias("_seen_spread"))
    )
    marked = rows.withColumn("_spread", F.when(has_key(), F.lit(0)).otherwise(F.xxhash64("event_id", "received_at")))
    by_key = (marked["idempotency_key"] == seen_keys["_seen_key"]) & (marked["_spread"] == seen_keys["_seen_spread"])
    unseen = marked.join(seen_keys, by_key, "left_anti").drop("_spread")

    new_content = rows.filter(~has_key() & F.col("booking_id").isNotNull()).select(*CONTENT_KEY).distinct()
    seen_content = stored.join(new_content, CONTENT_KEY, "left_semi")
    return drop_blocked(unseen, seen_content)


def split_id_conflicts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First row per event id, and the later rows that reuse an id."""
    kept = _first_per(rows, [F.col("event_id")])
    # only ids that repeat are joined back; a hot id is one row on that side
    repeated = rows.groupBy("event_id").agg(F.count("*").alias("_n"), F.min(_identity(rows)).alias("_first")).filter("_n > 1")
    later = rows.join(repeated, "event_id").filter(_identity(rows) != F.col("_first")).drop("_n", "_first")
    return kept, _conflict(later)


def accept(rows: DataFrame, legacy_scope: str, keep) -> tuple[DataFrame, DataFrame]:
    """The rows of one batch that are stored, and those rejected because their id is taken.

    A rejected row claims neither its key nor its content: once it is out, the rules are
    applied again, until no row is rejected any more. The rounds run over the columns that
    the rules compare; the whole rows, payload and all, move once, to meet the decision.
    ``keep`` stores a frame.
    """
    decided = decide(keep(rows.select(*[c for c in _ORDER if c in rows.columns]), "rule-columns"), legacy_scope, keep)
    # copies of a row are cut to one per input split before they move, and the join finds them in place
    rank = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    firsts = rows.withColumn("_row", _identity(rows)).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    settled = keep(firsts.join(decided, "_row").drop("_row"), "settled")
    return settled.filter("_stored").drop("_stored"), _conflict(settled.filter("NOT _stored").drop("_stored"))


def decide(left: DataFrame, legacy_scope: str, keep) -> DataFrame:
    """``_row``, the rule columns as one value, and ``_stored`` of the rows that are stored, and of those rejected."""
    decided = None
    while True:
        unique, conflicts = split_id_conflicts(keep(deduplicate(left, legacy_scope), "deduplicated"))
        conflicts = keep(conflicts.select(_identity(conflicts).alias("_row"), F.lit(False).alias("_stored")), "conflicts")
        decided = conflicts if decided is None else decided.unionByName(conflicts)
        if conflicts.isEmpty():
            break
        left = left.withColumn("_row", _identity(left)).join(conflicts.select("_row"), "_row", "left_anti").drop("_row")
    return decided.unionByName(unique.select(_identity(unique).alias("_row"), F.lit(True).alias("_stored")))


# what becomes of a contested row; of its copies one is stored or rejected, but all that were taken
_DROPPED, _STORED, _REJECTED, _TAKEN = range(4)
_PLACE = ["_row", "_check"]


def judge(contested: DataFrame, legacy_scope: str, keep) -> DataFrame:
    """Verdict and number of copies of each contested row, by its fingerprint.

    ``contested`` holds the rule columns of every row of a batch that shares a claim with
    another one, and by which of its claims it meets a stored row: ``_by_key``,
    ``_by_content``, ``_by_id``. Other rows have no say in it.
    """
    copy = F.col("_by_key") | F.col("_by_content")
    # rows whose id is stored claim no key; what the rules leave of them is rejected
    fresh, taken = contested.filter(~copy & ~F.col("_by_id")), contested.filter(~copy & F.col("_by_id"))
    verdicts = contested.select(*place(), F.lit(_DROPPED).alias("_verdict"), F.lit(1).alias("_copies"))

    def add(rows: DataFrame, verdict) -> DataFrame:
        return verdicts.unionByName(rows.select(*place(), verdict.alias("_verdict"), F.lit(0).alias("_copies")))

    log = contested.limit(0)
    if not fresh.isEmpty():
        decided = keep(decide(fresh.select(*_ORDER), legacy_scope, keep).select("_row.*", "_stored"), "decided")
        verdicts = add(decided, F.when(F.col("_stored"), _STORED).otherwise(_REJECTED))
        log = decided.filter("_stored")
    if not taken.isEmpty():
        verdicts = add(unclaimed(taken, log), F.lit(_TAKEN))
    return verdicts.groupBy(*_PLACE).agg(F.max("_verdict").alias("_verdict"), F.sum("_copies").alias("_copies"))


def settle(rows: DataFrame, verdicts: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """The rows of a batch that are stored, and those rejected; a row without a verdict is stored where it lies."""
    stored = F.col("_verdict") == _STORED
    whole = rows.select("*", *place())
    log = whole.join(verdicts.filter(~(stored & (F.col("_copies") == 1))), _PLACE, "left_anti")
    odd = keep(verdicts.filter((stored & (F.col("_copies") > 1)) | F.col("_verdict").isin(_REJECTED, _TAKEN)), "odd-verdicts")
    if odd.isEmpty():
        return log.drop(*_PLACE), _conflict(rows.limit(0))
    found = keep(whole.join(odd.drop("_copies"), _PLACE), "odd-rows")
    rank = F.row_number().over(Window.partitionBy(*_PLACE).orderBy(*_PLACE))
    single = found.filter(F.col("_verdict") != _TAKEN).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    log = log.unionByName(single.filter(stored).drop("_verdict")).drop(*_PLACE)
    conflicts = single.filter(~stored).unionByName(found.filter(F.col("_verdict") == _TAKEN))
    return log, _conflict(conflicts.drop("_verdict", *_PLACE))


def fingerprint(columns: Sequence[str], kind: str = "") -> tuple[Column, Column]:
    """128 bits of the values, as two numbers: they sort and compare faster than texts with a common start."""
    parts = [part for c in columns for part in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(F.lit(kind), *parts), F.xxhash64(F.lit(f"{kind}'"), *parts)


def place() -> list[Column]:
    """The fingerprint of the rule columns as ``_row`` and ``_check``; copies of a row share it."""
    return [part.alias(name) for part, name in zip(fingerprint(_ORDER, "row"), _PLACE)]


def unclaimed(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rejected rows that no earlier row of the log makes a duplicate."""
    order = F.struct("received_at", "event_id")
    keys = log.filter(has_key()).groupBy("idempotency_key").agg(F.min(order).alias("_first"))
    by_key = (rows["idempotency_key"] == keys["idempotency_key"]) & has_key_of(rows) & (keys["_first"] < F.struct(rows["received_at"], rows["event_id"]))
    return drop_blocked(rows.join(keys, by_key, "left_anti"), log, earlier_only=True)


def has_key_of(rows: DataFrame) -> Column:
    return F.coalesce(rows["idempotency_key"], F.lit("")) != ""


def split_stored_ids(rows: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id the stored log does not know, and the rows that reuse a stored id."""
    new_ids = rows.select("event_id").distinct()
    taken = stored.select("event_id").join(new_ids, "event_id", "left_semi").distinct()
    return rows.join(taken, "event_id", "left_anti"), _conflict(rows.join(taken, "event_id", "left_semi"))


def _conflict(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reject_reason", F.lit("event_id_conflict"))


def _identity(rows: DataFrame) -> Column:
    """The columns of ``_ORDER`` as one value that compares like the window order."""
    return F.struct(*[F.col(c) for c in _ORDER if c in rows.columns])


def bounded_dedup(stream: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Streaming alternative with limited memory: copies within ``horizon`` of each other.

    Keyed rows by key, other rows by content; rows without a booking all pass.
    """
    group = (
        F.when(has_key(), F.concat(F.lit("k:"), "idempotency_key"))
        .when(F.col("booking_id").isNull(), F.concat(F.lit("e:"), "event_id"))
        .otherwise(F.concat(F.lit("c:"), F.sha2(F.to_json(F.struct(*CONTENT_KEY)), 256)))
    )
    return (
        stream.withColumn("_group", group)
        .withWatermark("received_at", horizon)
        .dropDuplicatesWithinWatermark(["_group"])
        .drop("_group")
    )
