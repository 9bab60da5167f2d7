"""Message sources and envelope decoding.

A message is one row of ``headers``, ``body``, ``queue`` and ``received_at``. Decoding
is a narrow select; a message that cannot be read goes to the reject side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetledger.functions import json_fields as J
from meetledger.functions.hashing import payload_hash
from meetledger.functions.times import event_time
from meetledger.schemas import ENVELOPE_COLUMNS, HEADER_COLUMNS, MESSAGE_SCHEMA

# JSON values that count as "no payload", however they are written
_EMPTY_BODY = r'\A\s*(null|false|""|\[\s*\]|\{\s*\}|-?0(\.0+)?([eE][-+]?\d+)?)?\s*\z'


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", queues: list[str] | None = None) -> DataFrame:
    return select_queues(spark.read.schema(MESSAGE_SCHEMA).format(fmt).load(path), queues)


def stream_messages(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    queues: list[str] | None = None,
    max_files_per_trigger: int | None = None,
    consume: bool = False,
) -> DataFrame:
    """With ``consume`` a file is deleted once a later batch follows the one that read it."""
    reader = spark.readStream.schema(MESSAGE_SCHEMA).format(fmt)
    if consume:
        reader = reader.option("cleanSource", "delete")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return select_queues(reader.load(path), queues)


def stream_kafka(spark: SparkSession, servers: str, topics: list[str], **options: str) -> DataFrame:
    """Messages from Kafka, one topic per queue. Needs the Kafka package on the cluster."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("includeHeaders", "true")
    )
    return kafka_messages(reader.options(**options).load())


def kafka_messages(records: DataFrame) -> DataFrame:
    """Kafka records (headers, value, topic, timestamp) as messages."""
    pairs = F.transform(
        F.coalesce(F.col("headers"), F.array()),
        lambda h: F.struct(F.lower(h["key"]).alias("key"), h["value"].cast("string").alias("value")),
    )
    # the last header of a name counts
    names = F.array_distinct(F.transform(pairs, lambda h: h["key"]))
    values = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda h: h["key"] == n), -1)["value"])
    return records.select(
        F.map_from_arrays(names, values).alias("headers"),
        F.col("value").cast("string").alias("body"),
        F.col("topic").alias("queue"),
        F.col("timestamp").alias("received_at"),
    )


def select_queues(messages: DataFrame, queues: list[str] | None) -> DataFrame:
    """Only the queues asked for; an empty list means every queue."""
    return messages.filter(F.col("queue").isin(list(queues))) if queues else messages


def payload_or_empty(body: Column) -> Column:
    """The body text, or ``{}`` for a body that holds nothing."""
    return F.when(F.coalesce(body, F.lit("")).rlike(_EMPTY_BODY), F.lit("{}")).otherwise(body)


def decode_messages(messages: DataFrame, hash_mode: str = "live", unwrap_original: bool = False) -> DataFrame:
    """Envelope columns plus ``reject_reason``, NULL for a message that can be read."""
    header = {name: F.try_element_at("headers", F.lit(key)) for key, name in HEADER_COLUMNS.items()}
    body = payload_or_empty(F.col("body"))
    rows = messages.select(
        *[value.alias(name) for name, value in header.items() if name != "time"],
        header["time"].alias("_time"),
        event_time(header["time"], F.col("received_at")).alias("occurred_at"),
        "received_at",
        "queue",
        "body",
        body.alias("payload_json"),
        J.parse(body).alias("_doc"),
    )
    if unwrap_original:
        rows = rows.withColumn(
            "payload_json",
            F.when(J.is_object(F.col("_doc"), "$.original"), J.json_text(F.col("_doc"), "$.original")).otherwise(
                F.col("payload_json")
            ),
        )
    reason = (
        F.when(F.coalesce(F.col("event_id"), F.lit("")) == "", "missing_id")
        .when(F.coalesce(F.col("event_type"), F.lit("")) == "", "missing_type")
        .when(F.coalesce(F.col("source"), F.lit("")) == "", "missing_source")
        .when(F.col("occurred_at").isNull(), "bad_time")
        .when(F.col("_doc").isNull(), "bad_json")
        # without a booking only the raw log is written, and it takes any JSON
        .when((F.coalesce(F.col("booking_id"), F.lit("")) != "") & ~J.is_object(F.col("_doc")), "payload_not_object")
    )
    return rows.withColumn("payload_hash", payload_hash(F.col("payload_json"), hash_mode)).select(
        *ENVELOPE_COLUMNS, F.col("_time").alias("raw_time"), "body", reason.alias("reject_reason")
    )


def valid_envelopes(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reject_reason").isNull()).select(*ENVELOPE_COLUMNS)


def rejected_messages(decoded: DataFrame) -> DataFrame:
    """Dead letters: what arrived, and why it could not be read."""
    return decoded.filter(F.col("reject_reason").isNotNull()).select(
        "reject_reason", "queue", "received_at", "event_id", "event_type", "source", "booking_id", "raw_time", "body"
    )
