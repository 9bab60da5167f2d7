"""Projections: one table per kind of booking activity, built from facts.

Rows carry natural keys (booking, e-mail, job, event). A participant is the e-mail of a
participant already known when the event arrived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from meetledger import schemas as S
from meetledger.operators import extract as X
from meetledger.operators.folds import Fold, latest, latest_known
from meetledger.operators.lookup import known_email, left_lookup, seq
from meetledger.operators.scan import running_max


def by_role(role: Column) -> Column:
    """The event's organizer or client, as the role says."""
    return F.when(role == S.ROLE_ORGANIZER, F.col("organizer")).when(role == S.ROLE_CLIENT, F.col("client"))


def _order(order: str, event_time: Column) -> Column:
    """Arrival order, or (a deviation on request) event time before arrival."""
    if order == "arrival":
        return seq()
    return F.struct(event_time.alias("event_time"), *S.SEQ)


# --- meeting links ---


def meeting_rows(facts: DataFrame) -> DataFrame:
    who = F.coalesce("organizer", "client")
    return facts.filter(X.is_meeting() & who.isNotNull() & F.col("meeting_error").isNull()).select(
        "booking_id", who.alias("participant"), "meeting_url", "event_id", "occurred_at", "received_at"
    )


def meeting_fold() -> Fold:
    entry = F.struct("meeting_url", F.col("event_id").alias("source_event_id"), "occurred_at")
    return Fold(
        ["booking_id", "participant"],
        {"entry": latest(entry)},
        lambda rows: rows.select("booking_id", "participant", "entry.*"),
    )


def meeting_links(facts: DataFrame) -> DataFrame:
    """Last link per booking and participant."""
    return meeting_fold()(meeting_rows(facts))


# --- e-mail notifications ---


def email_rows(facts: DataFrame, participants: DataFrame) -> DataFrame:
    """Sent and status events in one shape, with their participant."""
    sent = F.col("event_type") == S.EMAIL_SENT
    rows = facts.filter(
        X.is_email()
        & F.col("job_id").isNotNull()
        & F.col("notification_error").isNull()
        & (sent | F.col("recipient_email").isNotNull())
    ).select(
        "job_id",
        "booking_id",
        F.when(sent, by_role(F.col("first_user_role"))).alias("_own"),
        "recipient_email",
        sent.alias("is_sent"),
        "trigger_event",
        "status",
        "status_time",
        "clicked_url",
        "event_id",
        "occurred_at",
        "received_at",
    )
    looked_up = known_email(rows, "recipient_email", participants, "_known")
    return looked_up.withColumn("participant", F.coalesce("_own", "_known")).drop("_own", "_known")


def email_fold(order: str = "arrival") -> Fold:
    """Sent and status halves of a job; each leaves the other's columns alone."""
    sent, status = F.col("is_sent"), ~F.col("is_sent")
    by_status = _order(order, F.col("status_time"))
    return Fold(
        ["job_id"],
        {
            "booking_id": latest(F.col("booking_id")),
            "participant": latest_known(F.col("participant")),
            "sent": latest(F.struct("trigger_event", F.col("event_id").alias("sent_event_id"), F.col("occurred_at").alias("sent_at")), when=sent),
            "state": latest(
                F.struct(
                    F.col("status").alias("last_status"),
                    F.col("status_time").alias("last_status_event_time"),
                    F.col("event_id").alias("last_status_event_id"),
                ),
                when=status,
                order=by_status,
            ),
            "last_clicked_url": latest_known(F.col("clicked_url"), when=status, order=by_status),
        },
        lambda rows: rows.select("job_id", "booking_id", "participant", "sent.*", "state.*", "last_clicked_url"),
    )


def email_notifications(facts: DataFrame, participants: DataFrame, order: str = "arrival") -> DataFrame:
    return email_fold(order)(email_rows(facts, participants))


# --- e-mail status history ---


def status_rows(facts: DataFrame) -> DataFrame:
    return facts.filter(X.is_mail_status() & F.col("job_id").isNotNull() & F.col("status").isNotNull()).select(
        "job_id", "status", "status_time", "event_id", "received_at"
    )


def status_fold(order: str = "arrival") -> Fold:
    entry = F.struct(F.col("status_time").alias("status_event_time"), F.col("event_id").alias("source_event_id"))
    return Fold(
        ["job_id", "status"],
        {"entry": latest(entry, order=_order(order, F.col("status_time")))},
        lambda rows: rows.select("job_id", "status", "entry.*"),
    )


def email_status_history(facts: DataFrame, order: str = "arrival", grain: str = "status") -> DataFrame:
    """Last entry per job and status, or with ``grain="event"`` one row per status event."""
    rows = status_rows(facts)
    if grain == "event":
        return rows.select("job_id", "status", F.col("status_time").alias("status_event_time"), F.col("event_id").alias("source_event_id"))
    return status_fold(order)(rows)


# --- telegram notifications ---


def telegram_rows(facts: DataFrame, participants: DataFrame) -> DataFrame:
    own = F.when(F.col("first_user_role") == S.ROLE_ORGANIZER, F.col("organizer")).otherwise(F.col("client"))
    rows = facts.filter(X.is_telegram() & F.col("notification_error").isNull()).select(
        "booking_id", own.alias("_own"), "recipient_email", "trigger_event", "event_id", "occurred_at", "received_at"
    )
    looked_up = known_email(rows, "recipient_email", participants, "_known")
    who = F.coalesce("_own", "_known")
    # a key with a NULL in it equals nothing, so such an event keeps a row of its own
    apart = F.when(who.isNull() | F.col("trigger_event").isNull(), F.col("event_id"))
    return looked_up.select(
        "booking_id", who.alias("participant"), "trigger_event", apart.alias("own_row"), "event_id", "occurred_at", "received_at"
    )


def telegram_fold() -> Fold:
    entry = F.struct(F.col("event_id").alias("sent_event_id"), F.col("occurred_at").alias("sent_at"))
    return Fold(
        ["booking_id", "participant", "trigger_event", "own_row"],
        {"entry": latest(entry)},
        lambda rows: rows.select("booking_id", "participant", "trigger_event", "entry.*"),
    )


def telegram_notifications(facts: DataFrame, participants: DataFrame) -> DataFrame:
    """Last message per booking, participant and trigger."""
    return telegram_fold()(telegram_rows(facts, participants))


# --- chat ---


def chat_events(facts: DataFrame, participants: DataFrame) -> DataFrame:
    """One row per chat event; ``is_read`` is filled by :func:`apply_reads`."""
    rows = facts.filter(X.is_chat() & F.col("chat_error").isNull()).select(
        "booking_id",
        "event_id",
        F.col("source").alias("provider"),
        F.col("chat_action").alias("chat_event_type"),
        "message_id",
        by_role(F.col("first_user_role")).alias("_own"),
        "acting_email",
        "text_preview",
        "occurred_at",
        "received_at",
    )
    looked_up = known_email(rows, "acting_email", participants, "_known")
    return looked_up.select(
        "booking_id",
        F.col("event_id").alias("raw_event_id"),
        "provider",
        "chat_event_type",
        "message_id",
        F.coalesce("_own", "_known").alias("participant"),
        "text_preview",
        "occurred_at",
        "received_at",
    )


def chat_reads(facts: DataFrame, participants: DataFrame) -> DataFrame:
    """Read events whose reader is known."""
    rows = facts.filter(X.is_chat_read() & F.col("read_error").isNull() & F.col("acting_email").isNotNull()).select(
        "booking_id", "acting_email", "last_read_message_id", "event_id", "occurred_at", "received_at"
    )
    return known_email(rows, "acting_email", participants, "reader").filter(F.col("reader").isNotNull()).drop("acting_email")


def apply_reads(chat: DataFrame, reads: DataFrame, chunk: str = "day") -> DataFrame:
    """Mark messages as read.

    A read event marks the messages of its booking that arrived no later, were written
    by somebody else, and either bear the message id it names or are older than it.
    No pair of message and read is ever formed:

    * by id: for each named message the latest read, and the latest one by another
      reader, decide; this is a lookup of one row per message id
    * by time: walking from the last arrival back, the newest read time so far and the
      newest one by another reader decide; both are running maxima
    """
    by_time = _reads_by_time(chat, reads, chunk)
    return _reads_by_id(by_time, reads).drop("_by_time")


def _reads_by_time(chat: DataFrame, reads: DataFrame, chunk: str) -> DataFrame:
    read_row = F.struct(F.col("occurred_at").alias("at"), F.col("reader").alias("reader"))
    both = chat.withColumn("_read", F.lit(None).cast("struct<at:timestamp,reader:string>")).unionByName(
        reads.select(
            "booking_id", F.col("event_id").alias("raw_event_id"), "received_at", read_row.alias("_read")
        ),
        allowMissingColumns=True,
    )
    keys, order = ["booking_id"], ["received_at", "raw_event_id", "_is_read"]
    both = both.withColumns({"_is_read": F.col("_read").isNotNull(), "_chunk": F.date_trunc(chunk, "received_at")})
    newest = running_max(both, keys, order, "_chunk", before={"_top": F.col("_read")}, descending=True)

    # the newest read by anybody but the reader of _top: what was the top until another
    # reader took over, or a later read by someone who did not
    leader = F.greatest(F.col("_top"), F.col("_read"))
    took_over = F.col("_top")["reader"] != leader["reader"]
    other = F.when(
        F.col("_is_read"),
        F.when(took_over, F.col("_top")["at"]).when(F.col("_read")["reader"] != leader["reader"], F.col("_read")["at"]),
    )
    runners_up = running_max(newest.withColumn("_other", other), keys, order, "_chunk", before={"_second": F.col("_other")}, descending=True)

    author = F.col("participant")
    bound = F.when(author != F.col("_top")["reader"], F.col("_top")["at"]).when(
        author == F.col("_top")["reader"], F.col("_second")
    )
    return runners_up.filter(~F.col("_is_read")).select(
        *chat.columns, F.coalesce(F.col("occurred_at") < bound, F.lit(False)).alias("_by_time")
    )


def _reads_by_id(chat: DataFrame, reads: DataFrame) -> DataFrame:
    named = reads.filter(F.col("last_read_message_id").isNotNull())
    per_reader = named.groupBy("booking_id", "last_read_message_id", "reader").agg(F.max(seq()).alias("at"))
    newest_first = Window.partitionBy("booking_id", "last_read_message_id").orderBy(F.desc("at"))
    two = per_reader.withColumn("_rank", F.row_number().over(newest_first)).filter("_rank <= 2")
    table = two.groupBy("booking_id", "last_read_message_id").agg(
        F.max(F.when(F.col("_rank") == 1, F.struct("at", "reader"))).alias("_best"),
        F.max(F.when(F.col("_rank") == 2, F.col("at"))).alias("_next"),
    )
    target = (F.col("chat_event_type") == S.NEW_MESSAGE_ACTION) & F.col("participant").isNotNull()
    key = F.when(target & F.col("message_id").isNotNull(), F.to_json(F.struct("booking_id", "message_id")))
    table = table.select(
        F.to_json(F.struct("booking_id", F.col("last_read_message_id").alias("message_id"))).alias("_message"), "_best", "_next"
    )
    joined = left_lookup(chat.withColumn("_key", key), table, "_key", "_message", "raw_event_id")
    arrived = F.struct("received_at", F.col("raw_event_id").alias("event_id"))
    foreign = F.when(F.col("participant") != F.col("_best")["reader"], F.col("_best")["at"]).otherwise(F.col("_next"))
    by_id = F.coalesce(arrived <= foreign, F.lit(False))
    return joined.withColumn("is_read", F.when(target & (by_id | F.col("_by_time")), F.lit(True))).drop("_key", "_best", "_next")


# --- video ---


def video_events(facts: DataFrame) -> DataFrame:
    """One row per video event; the participant comes from the role alone."""
    return facts.filter(X.is_video() & F.col("video_error").isNull()).select(
        "booking_id",
        F.col("event_id").alias("raw_event_id"),
        F.col("video_action").alias("video_event_type"),
        F.col("video_role").alias("participant_role"),
        by_role(F.col("video_role")).alias("participant"),
        F.col("video_time").alias("event_time"),
        F.col("video_payload").alias("payload"),
        "received_at",
    )


def new_rows(rows: DataFrame, stored: DataFrame, key: str = "raw_event_id") -> DataFrame:
    """Insert-once: without the rows whose key is already stored."""
    return rows.join(stored.select(key).join(rows.select(key), key, "left_semi").distinct(), key, "left_anti")
