"""Publishing: events as messages, addressed by the routing rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetledger.operators.routing import DEFAULT_RULES, Rule, destination
from meetledger.schemas import QUEUE_DEFAULT


def outgoing_messages(events: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, default: str = QUEUE_DEFAULT) -> DataFrame:
    """routing_key, headers, body and message_type for each event.

    ``events`` has source, event_type and payload_json; event_id, occurred_at (or text
    ``time``), booking_id and the tracing columns are optional. A missing id or time is
    filled in. Narrow: no shuffle.
    """
    have = set(events.columns)

    def optional(column: str):
        return F.col(column) if column in have else F.lit(None).cast("string")

    if "time" in have:
        time = F.col("time")
    elif "occurred_at" in have:
        time = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    else:
        time = F.lit(None).cast("string")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    headers = {
        "ce-specversion": F.lit("1.0"),
        "ce-id": F.coalesce(F.nullif(optional("event_id"), F.lit("")), F.uuid()),
        "ce-type": F.col("event_type"),
        "ce-source": F.col("source"),
        "ce-time": F.coalesce(F.nullif(time, F.lit("")), now),
        "ce-booking_id": optional("booking_id"),
        "ce-idempotencykey": optional("idempotency_key"),
        "ce-traceid": optional("trace_id"),
        "ce-spanid": optional("span_id"),
        "ce-dataschema": optional("dataschema"),
    }
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in headers]), F.array(*headers.values()))
    return events.select(
        destination(F.col("source"), F.col("event_type"), rules, default).alias("routing_key"),
        F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("headers"),
        F.coalesce("payload_json", F.lit("{}")).alias("body"),
        F.lit("application/json").alias("content_type"),
        F.col("event_type").alias("message_type"),
    )


def write_messages(messages: DataFrame, path: str) -> None:
    """One folder per routing key."""
    messages.write.mode("append").partitionBy("routing_key").parquet(path)


def kafka_records(messages: DataFrame) -> DataFrame:
    """topic, value and headers columns for a Kafka sink."""
    return messages.select(
        F.col("routing_key").alias("topic"),
        F.col("body").cast("binary").alias("value"),
        F.transform(
            F.map_entries("headers"), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value"))
        ).alias("headers"),
    )
