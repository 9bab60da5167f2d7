"""Spark session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. Naive times are UTC; a JSON object that
# repeats a key keeps the last one; the skewed side of a lookup join is split. The
# extraction of facts makes for long generated methods, which the JVM would not compile
# if they were fused into one; the limit makes Spark generate it in smaller pieces.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# A task sorts what it reads, so what it reads stays small however large the input is.
TASK_BYTES = 32 << 20
TASK_CONF = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]

# Settings of a running stream: a shuffle is of no use once its write is done, and else stays
# until the driver collects its garbage. A frame that is collected twice is computed twice
# under them, so they do not stay in a session that others use.
STREAM_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Write options: most of a log is ids and hashes in hexadecimal, which zstd halves.
PACKED = {"compression": "zstd"}

CHECKPOINT_CONF = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key in TASK_CONF:
        if _bytes(spark.conf.get(key)) > TASK_BYTES:
            spark.conf.set(key, str(TASK_BYTES))
    return spark


@contextmanager
def as_stream(*sessions: SparkSession) -> Iterator[None]:
    """The settings of a stream for a while; a query that is started meanwhile keeps them."""
    before = [(s, key, s.conf.get(key, None)) for s in sessions for key in STREAM_CONF]
    for session, key, _ in before:
        session.conf.set(key, STREAM_CONF[key])
    try:
        yield
    finally:
        for session, key, value in before:
            if value is None:
                session.conf.unset(key)
            else:
                session.conf.set(key, value)


def _bytes(setting: str) -> int:
    """A size as Spark writes it: a number with b, k, m, g, t or p (and b) behind it."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([bkmgtp]?)b?\s*", setting.lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def create_session(app_name: str = "meetledger", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and stream checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may fall
    back to a folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="meetledger-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and keeps column pruning and filter
    pushdown for the readers, which a row-based checkpoint would not.
    """
    return _written(df, fresh_path(df.sparkSession, name))


def _written(df: DataFrame, path: str, **options: str) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Frames that are needed for a while: kept as by :func:`materialize`, and deleted together at the end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(fresh_path(df.sparkSession, name))
        return _written(df, self.paths[-1], **PACKED)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
