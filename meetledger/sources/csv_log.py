"""CSV event logs: event_id, booking_id, event_type, source, payload, hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetledger.operators.routing import DEFAULT_RULES, destination
from meetledger.schemas import ENVELOPE_COLUMNS, QUEUE_DEFAULT

CSV_SCHEMA = "event_id string, booking_id string, event_type string, source string, payload string, hash string"


def read_csv_log(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(CSV_SCHEMA)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )


def csv_envelopes(log: DataFrame, received_at: str = "1970-01-01 00:00:00") -> DataFrame:
    """Envelopes of a CSV log. The log holds no times, so all rows get ``received_at``."""
    stamp = F.lit(received_at).cast("timestamp")
    known = {
        "event_id": F.col("event_id"),
        "booking_id": F.col("booking_id"),
        "event_type": F.col("event_type"),
        "source": F.col("source"),
        "occurred_at": stamp,
        "received_at": stamp,
        "queue": destination(F.col("source"), F.col("event_type"), DEFAULT_RULES, QUEUE_DEFAULT),
        "payload_json": F.col("payload"),
        "payload_hash": F.md5("payload"),
    }
    return log.select(*[known.get(c, F.lit(None).cast("string")).alias(c) for c in ENVELOPE_COLUMNS])
