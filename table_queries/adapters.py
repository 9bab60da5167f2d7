"""The given tables read as event logs.

The tables are no booking events, so each adapter maps whole rows to the envelope
(`event_log`, `order_log`, `mail_log`, `conversation_log`): keys, times and a JSON payload
are derived from the columns. The operators then run on them unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetledger import schemas as S
from meetledger.operators.routing import destination
from meetledger.session import fresh_path, materialize, prepare, work_dir
from meetledger.sources.log_layout import read_log, write_log

# (event_type of the table, k modulo 3) -> (type, source)
TYPE_MAP = {
    ("purchase", 0): (S.BOOKING_CREATED, "booking"),
    ("purchase", 1): (S.BOOKING_REASSIGNED, "booking"),
    ("purchase", 2): ("booking.rescheduled", "booking"),
    ("click", 0): (S.CHAT_MESSAGE_NEW, "getstream"),
    ("click", 1): (S.CHAT_MESSAGE_READ, "getstream"),
    ("click", 2): ("booking.events.v1.chat.message_sent.create", "booking"),
    ("view", 0): ("jitsi.events.v1.audioMuteStatusChanged.create", "jitsi-eu"),
    ("view", 1): ("jitsi.events.v1.deviceListChanged.create", "jitsi-eu"),
    ("view", 2): ("jitsi.events.v1.create", "jitsi"),
    ("signup", 0): (S.EMAIL_SENT, "booking"),
    ("signup", 1): (S.TELEGRAM_SENT, "booking"),
    ("signup", 2): (S.MEETING_URL_CREATED, "booking"),
    ("error", 0): (S.MAIL_STATUS, "unisender-go"),
    ("error", 1): ("billing.v1.charge.create", "billing"),
    ("error", 2): ("chat.created", "chat"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as in the given tables."""
    return df.select(
        *[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema]
    )


def spread(rows: DataFrame) -> DataFrame:
    """The rows in as many pieces as there are cores; they move, narrow as they are, only where files have fewer."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


_STORED: dict[tuple[str, str, str, str], DataFrame] = {}


def stored(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Write the log once per session, as a log is a stored table wherever it comes from."""

    @wraps(build)
    def read(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
        key = (spark.sparkContext.applicationId, work_dir(prepare(spark)), sf_dir, f"{build.__name__}{sorted(options.items())}")
        if key not in _STORED:
            # written where it is built: the wide rows do not move
            _STORED[key] = materialize(build(spark, sf_dir, **options), build.__name__)
        return _STORED[key]

    return read


def laid_out(log: Callable[..., DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log from its layout by day and booking, written once per session."""
    key = (spark.sparkContext.applicationId, work_dir(prepare(spark)), sf_dir, f"{log.__name__} by day")
    if key not in _STORED:
        rows = log(spark, sf_dir)
        path = fresh_path(spark, f"{log.__name__}-by-day")
        write_log(rows, path)
        _STORED[key] = read_log(spark, path, schema=rows.schema)
    return _STORED[key]


def _pick(index: int, fallback: str) -> Column:
    chain = F
    for (base, part), target in TYPE_MAP.items():
        chain = chain.when((F.col("base") == base) & (F.col("k") % 3 == part), target[index])
    return chain.otherwise(fallback)


def iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


@stored
def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with envelope keys and times: ids padded, every tenth user without a booking."""
    return (
        spread(table(spark, sf_dir, "events"))
        .select(
            F.col("event_id").alias("n"),
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"),
            "user_id",
            F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("b"), "user_id")).alias("booking_id"),
            F.col("event_type").alias("base"),
            F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
            F.col("ts").cast("timestamp").alias("received_at"),
            "props",
        )
        .withColumn("occurred_at", F.expr("received_at - make_dt_interval(0, 0, k, 0)"))
        .withColumn("event_type", _pick(0, "unknown"))
        .withColumn("source", _pick(1, "unknown"))
        .withColumn("queue", destination(F.col("source"), F.col("event_type")))
        .withColumn("payload_hash", F.md5("props"))
        .withColumn(
            "idempotency_key",
            F.when(
                F.col("n") % 3 != 0,
                F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "base", F.date_format("received_at", "yyyy-MM-dd"))),
            ),
        )
        .withColumn("trace_id", F.concat(F.lit("t"), (F.col("n") % 97).cast("string")))
        .withColumn("span_id", F.lit(None).cast("string"))
        .withColumn("dataschema", F.lit(None).cast("string"))
    )


def _event_payload() -> Column:
    k, user = F.col("k"), F.col("user_id")
    kind = F.col("event_type")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    organizer = F.when(k % 5 != 0, text("org", (k % 5).cast("string"), "@x.org"))
    client = F.when(user % 7 != 0, text("cli", (user % 7).cast("string"), "@x.org"))
    normalized = F.when(
        k % 4 != 3,
        F.struct(
            F.array(
                F.struct(organizer.alias("email"), F.lit("organizer").alias("role"), F.when(k % 2 == 0, "UTC").alias("time_zone")),
                F.struct(client.alias("email"), F.lit("client").alias("role"), text("zone", (k % 3).cast("string")).alias("time_zone")),
            ).alias("participants"),
            F.struct(
                iso("occurred_at").alias("start_time"),
                F.when(k % 2 == 0, iso("received_at")).alias("end_time"),
                F.when(kind == S.BOOKING_CREATED, "created").alias("status"),
            ).alias("booking"),
        ),
    )
    job = text("job", user.cast("string"), "-", (k % 4).cast("string"))
    actor = text("cli", (user % 9).cast("string"), "@x.org")
    mail = kind == S.MAIL_STATUS
    return F.to_json(
        F.struct(
            normalized.alias("normalized"),
            F.when(kind == S.MEETING_URL_CREATED, F.when(k % 11 != 0, text("https://meet.x.org/", k.cast("string")))).alias("meeting_url"),
            F.when(kind.isin(S.EMAIL_SENT), job).alias("job_id"),
            F.when(kind.isin(S.EMAIL_SENT, S.TELEGRAM_SENT) & (k % 4 != 0), text("T", (k % 4).cast("string"))).alias("trigger_event"),
            F.when(
                ~mail, F.array(F.struct(actor.alias("email"), F.when(k % 6 < 2, "organizer").when(k % 6 < 4, "client").alias("role")))
            ).alias("users"),
            F.when(kind.isin(S.EMAIL_SENT, S.TELEGRAM_SENT), actor).alias("email"),
            F.when(
                mail,
                F.struct(
                    actor.alias("email"),
                    job.alias("job_id"),
                    text("s", (k % 5).cast("string")).alias("status"),
                    F.when(k % 6 == 0, text("https://c.x.org/", k.cast("string"))).alias("url"),
                    iso("occurred_at").alias("event_time"),
                ),
            ).alias("event_data"),
            F.when(kind == S.CHAT_MESSAGE_NEW, "message.new").when(kind == S.CHAT_MESSAGE_READ, "message.read").alias("type"),
            F.when(
                kind == S.CHAT_MESSAGE_NEW,
                F.struct(text("m", (k % 30).cast("string")).alias("id"), F.repeat(F.lit("né"), k * 6).alias("text")),
            ).alias("message"),
            F.when(kind == S.CHAT_MESSAGE_READ, text("m", (k % 30 - 1).cast("string"))).alias("last_read_message_id"),
            iso("received_at").alias("time"),
            F.struct(F.struct(F.when(k % 4 == 0, "organizer").when(k % 4 == 1, "client").alias("role")).alias("user")).alias("context"),
            F.when(k % 2 == 0, F.lit(True)).alias("muted"),
            F.when(k % 2 == 1, F.struct(k.alias("count"))).alias("devices"),
        )
    )


@stored
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of all kinds of activity from ``events``."""
    return raw_events(spark, sf_dir).withColumn("payload_json", _event_payload()).select(*S.ENVELOPE_COLUMNS)


@stored
def event_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as broker messages, some of them damaged."""
    rows = raw_events(spark, sf_dir).withColumn("damage", F.col("n") % 50)
    damaged = lambda n, value: F.when(F.col("damage") != n, value)
    headers = {
        "ce-id": damaged(1, F.col("event_id")),
        "ce-type": damaged(2, F.col("event_type")),
        "ce-source": damaged(3, F.col("source")),
        "ce-time": F.when(F.col("damage") == 4, F.lit("soon")).when(F.col("damage") != 5, iso("occurred_at")),
        "ce-booking_id": F.col("booking_id"),
        "ce-idempotencykey": F.col("idempotency_key"),
        "ce-traceid": F.col("trace_id"),
    }
    return rows.select(
        "n",
        F.map_from_arrays(F.array(*[F.lit(h) for h in headers]), F.array(*headers.values())).alias("headers"),
        F.when(F.col("damage") == 6, F.lit("{not json")).when(F.col("damage") == 7, F.lit("")).when(F.col("damage") == 8, F.lit("[1]")).otherwise(
            F.col("props")
        ).alias("body"),
        "queue",
        "received_at",
    )


@stored
def order_log(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    """Booking lifecycle envelopes from ``orders`` and ``customer``: one booking per customer.

    With ``late`` the orders arrive up to a month after they were made.
    """
    orders, customers = spread(table(spark, sf_dir, "orders")), table(spark, sf_dir, "customer")
    made = F.col("o_orderdate").cast("timestamp")
    named = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    rows = named.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("event_id"),
        F.concat(F.lit("b"), "o_custkey").alias("booking_id"),
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        "c_name",
        made.alias("occurred_at"),
        (F.expr("cast(o_orderdate as timestamp) + make_dt_interval(cast(o_orderkey % 30 as int), 0, 0, 0)") if late else made).alias("received_at"),
    )
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    kind = F.when(status == "O", S.BOOKING_CREATED).when(status == "F", S.BOOKING_REASSIGNED).otherwise(S.BOOKING_CANCELLED)
    payload = F.struct(
        F.struct(
            F.array(
                F.struct(
                    F.when(~priority.startswith("3"), F.concat(F.lit("org"), F.left(priority, F.lit(1)))).alias("email"),
                    F.lit("organizer").alias("role"),
                    F.lit(None).cast("string").alias("time_zone"),
                ),
                F.struct(
                    F.col("c_name").alias("email"),
                    F.when(status == "O", "client").when(status == "F", "guest").alias("role"),
                    F.when(priority < "3", F.lower(priority)).alias("time_zone"),
                ),
            ).alias("participants"),
            F.struct(
                iso("occurred_at").alias("start_time"),
                F.when(status != "P", status).alias("status"),
            ).alias("booking"),
        ).alias("normalized")
    )
    filled = {
        "event_type": kind,
        "source": F.lit("booking"),
        "queue": F.when(priority < "4", F.lit(S.QUEUE_LIFECYCLE)).otherwise(F.lit("events.unrouted")),
        "payload_json": F.to_json(payload),
    }
    return _envelope(rows.withColumns(filled))


def _envelope(rows: DataFrame) -> DataFrame:
    have = rows.columns
    rows = rows.withColumn("payload_hash", F.md5("payload_json"))
    return rows.select(*[F.col(c) if c in have or c == "payload_hash" else F.lit(None).cast("string").alias(c) for c in S.ENVELOPE_COLUMNS])


def mail_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sent mails from ``orders``, their delivery statuses from ``lineitem``; the order is the job.

    Not stored: its readers take their facts from it in one pass, and store those.
    """
    orders, items = spread(table(spark, sf_dir, "orders")), spread(table(spark, sf_dir, "lineitem"))
    person = lambda c: F.concat(F.lit("cust"), F.col(c).cast("string"))
    made = F.col("o_orderdate").cast("timestamp")
    sent = orders.select(
        F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("event_id"),
        F.concat(F.lit("b"), "o_custkey").alias("booking_id"),
        F.lit(S.EMAIL_SENT).alias("event_type"),
        F.lit("booking").alias("source"),
        made.alias("occurred_at"),
        made.alias("received_at"),
        F.lit("events.notification.delivery").alias("queue"),
        F.to_json(
            F.struct(
                F.col("o_orderkey").cast("string").alias("job_id"),
                F.when(F.col("o_orderpriority") < "5", F.col("o_orderpriority")).alias("trigger_event"),
                F.array(F.struct(F.when(F.col("o_orderstatus") == "F", "client").otherwise("guest").alias("role"))).alias("users"),
                F.when(F.col("o_orderstatus") == "O", person("o_custkey")).alias("email"),
                F.struct(F.array(F.struct(person("o_custkey").alias("email"), F.lit("client").alias("role"))).alias("participants")).alias("normalized"),
            )
        ).alias("payload_json"),
    )
    shipped = F.col("l_shipdate").cast("timestamp")
    status = items.select(
        F.concat_ws("-", F.lit("s"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"),
        F.concat(F.lit("b"), F.col("l_suppkey")).alias("booking_id"),
        F.lit(S.MAIL_STATUS).alias("event_type"),
        F.lit("unisender-go").alias("source"),
        shipped.alias("occurred_at"),
        shipped.alias("received_at"),
        F.lit("events.mail").alias("queue"),
        F.to_json(
            F.struct(
                F.struct(
                    person("l_partkey").alias("email"),
                    F.col("l_orderkey").cast("string").alias("job_id"),
                    F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("status"),
                    F.when(F.col("l_returnflag") == "R", F.concat(F.lit("https://x.org/"), F.col("l_partkey").cast("string"))).alias("url"),
                    F.when(F.col("l_returnflag") != "N", iso("l_shipdate")).alias("event_time"),
                ).alias("event_data")
            )
        ).alias("payload_json"),
    )
    return _envelope(sent.unionByName(status))


@stored
def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat envelopes from ``conversations``: every third turn is a read event of its speaker."""
    rows = spread(table(spark, sf_dir, "conversations"))
    read = F.col("turn") % 3 == 2
    role = F.when(F.col("role") == "user", "client").when(F.col("role") == "assistant", "organizer")
    speaker = F.concat(F.col("role"), F.lit("@x.org"))
    said = F.expr("timestamp '2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(turn as int), 0)")
    kind = F.when(read, S.CHAT_MESSAGE_READ).otherwise(S.CHAT_MESSAGE_NEW)
    payload = F.struct(
        F.when(read, "message.read").otherwise("message.new").alias("type"),
        F.when(~read, F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("text"))).alias("message"),
        F.when(read, F.concat(F.lit("m"), (F.col("turn") - 1).cast("string"))).alias("last_read_message_id"),
        F.array(F.struct(speaker.alias("email"), role.alias("role"))).alias("users"),
        F.struct(F.array(F.struct(speaker.alias("email"), role.alias("role"))).alias("participants")).alias("normalized"),
    )
    return _envelope(
        rows.select(
            F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("event_id"),
            F.concat(F.lit("b"), "conv_id").alias("booking_id"),
            kind.alias("event_type"),
            F.lit("getstream").alias("source"),
            said.alias("occurred_at"),
            said.alias("received_at"),
            F.lit(S.QUEUE_CHAT).alias("queue"),
            F.to_json(payload).alias("payload_json"),
        )
    )
