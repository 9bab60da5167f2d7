"""The event log laid out so that reads by booking, type, trace and time skip files.

The log is partitioned by the day of arrival and range-sorted by booking within it. A filter
on the time of arrival prunes folders; one on the booking prunes files and row groups by
their smallest and largest value; one on the type or the trace prunes row groups by their
dictionaries and Bloom filters. All of it is Spark's own scan: a reader only has to compare
the plain column with a value.

Rows of one booking and day are cut by time, so that a booking with a large share of all
rows is spread over files, and rows without a booking are spread like any other value.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

DAY = "received_day"
BLOOM_COLUMNS = ("trace_id", "event_type", "event_id")


def write_log(log: DataFrame, path: str, rows_per_file: int = 0, mode: str = "error") -> None:
    """Write a log with its arrival day (a null day holds rows without ``received_at``).

    ``mode="append"`` adds a batch: its rows go to files of their own, sorted like the others.
    """
    order = [DAY, *[c for c in ("booking_id", "received_at", "event_id") if c in log.columns]]
    spread = log.withColumn(DAY, F.to_date("received_at")).repartitionByRange(*order)
    writer = spread.sortWithinPartitions(*order).write.partitionBy(DAY).mode(mode).option("maxRecordsPerFile", rows_per_file)
    for column in BLOOM_COLUMNS:
        if column in log.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def read_log(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None, schema: StructType | None = None) -> DataFrame:
    """The stored log, without the column of the layout; only rows received in [since, until) when given.

    The bounds are UTC and prune whole days before they are applied to the rows. ``schema`` is
    that of the log; a log that may be empty needs it.
    """
    reader = spark.read.schema(StructType([*schema.fields, StructField(DAY, DateType())])) if schema is not None else spark.read
    log = reader.parquet(path)
    if since is not None:
        log = log.filter((F.col(DAY) >= F.lit(since.date())) & (F.col("received_at") >= F.lit(since)))
    if until is not None:
        log = log.filter((F.col(DAY) <= F.lit(until.date())) & (F.col("received_at") < F.lit(until)))
    return log.drop(DAY)


def read_costs(df: DataFrame) -> dict[str, int]:
    """Files and rows that the scans of a frame read; runs it.

    Taken from the metrics of the plan that ran, so pruned files and row groups do not count;
    the input of a global sort counts twice, as Spark samples it first.
    """
    df.collect()
    costs = {"files": 0, "rows": 0}

    def visit(plan) -> None:
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return visit(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return visit(plan.plan())
        metrics = plan.metrics()
        if metrics.contains("numFiles"):
            costs["files"] += metrics.apply("numFiles").value()
            costs["rows"] += metrics.apply("numOutputRows").value()
        children = plan.children()
        for k in range(children.size()):
            visit(children.apply(k))

    visit(df._jdf.queryExecution().executedPlan())
    return costs
