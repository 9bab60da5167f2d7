"""Entities: participants, bookings and the organizer history of a booking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetledger import schemas as S
from meetledger.operators.folds import Fold, first, greatest, latest, latest_known
from meetledger.operators.lookup import seq
from meetledger.operators.scan import running_max

# --- participants ---


def participant_rows(facts: DataFrame) -> DataFrame:
    """One row per participant named in an event, with its place in the payload."""
    return facts.select(*S.SEQ, F.posexplode("participants").alias("pos", "p")).select(*S.SEQ, "pos", "p.*")



def participant_fold() -> Fold:
    mention = F.struct("received_at", "event_id", "pos")
    return Fold(
        keys=["email"],
        columns={
            "role": latest_known(F.col("role"), order=mention),
            "time_zone": latest_known(F.col("time_zone"), order=mention),
            "first_seq": first(seq(), order=mention),
        },
    )


def participants(facts: DataFrame) -> DataFrame:
    """email, role, time_zone and first_seq, the arrival of the first mention."""
    return participant_fold()(participant_rows(facts))


def changed_participants(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``new`` that would change ``stored``: new e-mails, new roles, new time zones."""
    old = stored.select(F.col("email").alias("_e"), F.col("role").alias("_r"), F.col("time_zone").alias("_z"))
    same = (
        (new["email"] == old["_e"])
        & (new["role"].isNull() | new["role"].eqNullSafe(old["_r"]))
        & (new["time_zone"].isNull() | new["time_zone"].eqNullSafe(old["_z"]))
    )
    return new.join(old, same, "left_anti")


def merge_participants(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Pairwise merge by e-mail; the new side wins where it has a value."""
    return stored.alias("a").join(new.alias("b"), "email", "full").select(
        "email", F.coalesce("b.role", "a.role").alias("role"), F.coalesce("b.time_zone", "a.time_zone").alias("time_zone")
    )


# --- bookings ---


def is_lifecycle() -> Column:
    return F.coalesce(F.col("queue") == S.QUEUE_LIFECYCLE, F.lit(False))


_BOOKING_VALUES = {
    "start_time": "start_time",
    "end_time": "end_time",
    "current_status": "booking_status",
    "organizer": "organizer",
    "client": "client",
}


def booking_fold() -> Fold:
    """A booking takes every event of the lifecycle queue, and its very first event of any queue.

    Both parts are aggregates: the first event is a minimum by arrival, so no event has
    to be compared with the others of its booking.
    """
    columns = {
        "first_event": first(
            F.struct("event_id", "occurred_at", *[F.col(c).alias(n) for n, c in _BOOKING_VALUES.items()])
        ),
        "lifecycle_seen": greatest(F.col("occurred_at"), when=is_lifecycle()),
    }
    for name, source in _BOOKING_VALUES.items():
        columns[name] = latest_known(F.col(source), when=is_lifecycle())
    return Fold(keys=["booking_id"], columns=columns, finish=_finish_bookings)


def _finish_bookings(rows: DataFrame) -> DataFrame:
    head = F.col("first_event")
    return rows.select(
        "booking_id",
        head["occurred_at"].alias("first_seen_at"),
        F.greatest(head["occurred_at"], F.col("lifecycle_seen")).alias("last_seen_at"),
        *[F.coalesce(F.col(n), head[n]).alias(n) for n in _BOOKING_VALUES],
        head["event_id"].alias("first_event_id"),
    )


def bookings(facts: DataFrame) -> DataFrame:
    return booking_fold()(facts)


# --- organizer history ---

_CANDIDATE = ["booking_id", "organizer", "event_id", "occurred_at", "received_at"]


def organizer_candidates(facts: DataFrame, booking_table: DataFrame) -> DataFrame:
    """Created and reassigned events that reach the booking and name an organizer."""
    named = facts.filter(
        F.col("event_type").isin(S.BOOKING_CREATED, S.BOOKING_REASSIGNED) & F.col("organizer").isNotNull()
    ).select(*_CANDIDATE, is_lifecycle().alias("_lifecycle"))
    heads = booking_table.select("booking_id", F.col("first_event_id").alias("event_id"))
    # outside the lifecycle queue only the first event of a booking counts; the event id
    # in the join key keeps a busy booking from becoming a busy partition
    others = named.filter(~F.col("_lifecycle")).join(heads, ["booking_id", "event_id"], "left_semi")
    return named.filter("_lifecycle").select(*_CANDIDATE).unionByName(others.select(*_CANDIDATE))


def organizer_history(candidates: DataFrame, chunk: str = "day") -> DataFrame:
    """Organizer changes of each booking, in arrival order.

    A candidate is kept when its organizer differs from that of the newest entry so far,
    newest by ``effective_from`` and then by arrival. Times may arrive out of order, so
    this is a fold with a state; it is split so that only short stretches are folded:

    * a *record* is a candidate no earlier than all before it; after one, the newest
      entry names its organizer, whatever happened before
    * a candidate that follows a record within a run of one organizer changes nothing
    * a record that follows a record of another organizer starts from a known state, so
      the stretches between such resets are independent of each other

    What is left is walked in order, one stretch after the other, with one entry of
    state; no group is ever held in memory.
    """
    keys, order = ["booking_id"], S.SEQ
    scanned = running_max(
        candidates.withColumn("_chunk", F.date_trunc(chunk, "received_at")),
        keys,
        order,
        "_chunk",
        before={
            "_prev": F.struct(*S.SEQ, "organizer", "occurred_at"),
            "_top": F.col("occurred_at"),
        },
    )
    starts = F.col("_prev").isNull()
    flagged = scanned.select(
        *_CANDIDATE,
        "_chunk",
        (starts | (F.col("occurred_at") >= F.col("_top"))).alias("_record"),
        (starts | (F.col("_prev")["organizer"] != F.col("organizer"))).alias("_change"),
        (starts | (F.col("_prev")["occurred_at"] == F.col("_top"))).alias("_after_record"),
    ).withColumn("_reset", F.col("_record") & F.col("_change") & F.col("_after_record"))
    stretched = running_max(
        flagged,
        keys,
        order,
        "_chunk",
        before={"_last_record": F.when(F.col("_record"), seq())},
        upto={"_run": F.when(F.col("_change"), seq()), "_stretch": F.when(F.col("_reset"), seq())},
    )
    settled = F.coalesce(F.col("_last_record") >= F.col("_run"), F.lit(False))
    open_rows = stretched.filter(~settled).select(*_CANDIDATE, F.col("_stretch").alias("stretch"))
    return (
        open_rows.repartition("booking_id", "stretch")
        .sortWithinPartitions("booking_id", "stretch", *S.SEQ)
        .select("booking_id", F.to_json("stretch").alias("stretch"), "organizer", "event_id", "occurred_at", "received_at")
        .mapInPandas(
            _stretch_fold(),
            "booking_id string, organizer string, source_event_id string, effective_from timestamp, received_at timestamp",
        )
    )


def _stretch_fold():
    """The fold as a function of its own, so that workers need not import this package."""

    def fold(batches):
        place, newest_at, newest = None, None, None
        for batch in batches:
            keep = []
            for booking, stretch, organizer, at in zip(batch["booking_id"], batch["stretch"], batch["organizer"], batch["occurred_at"]):
                if (booking, stretch) != place:
                    place, newest_at, newest = (booking, stretch), None, None
                is_new = organizer != newest
                keep.append(is_new)
                if is_new and (newest_at is None or at >= newest_at):
                    newest_at, newest = at, organizer
            yield batch.loc[keep, ["booking_id", "organizer", "event_id", "occurred_at", "received_at"]].rename(
                columns={"event_id": "source_event_id", "occurred_at": "effective_from"}
            )

    return fold


def latest_organizer(history: DataFrame) -> DataFrame:
    """Newest entry per booking: by effective_from, then by arrival."""
    order = F.struct("effective_from", "received_at", F.col("source_event_id").alias("event_id"))
    newest = latest(F.struct("organizer", "effective_from"), order=order)
    return Fold(
        ["booking_id"],
        {"entry": newest},
        lambda rows: rows.select("booking_id", F.col("entry")["organizer"].alias("organizer"), F.col("entry")["effective_from"].alias("effective_from")),
    )(history)


def organizer_periods(history: DataFrame, chunk: str = "day") -> DataFrame:
    """History with the end of each period, where the next entry begins."""
    # entries are ordered by their begin, so the next begin is the smallest one ahead
    begin = F.unix_micros("effective_from")
    ahead = running_max(
        history.withColumn("_chunk", F.date_trunc(chunk, "effective_from")),
        ["booking_id"],
        ["effective_from", "received_at", "source_event_id"],
        "_chunk",
        before={"_next": -begin},
        descending=True,
    )
    return ahead.withColumn("effective_to", F.timestamp_micros(-F.col("_next"))).drop("_chunk", "_next")
