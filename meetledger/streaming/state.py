"""Current tables kept as state of a stream, and the changes of each batch.

The ingest appends partial folds; merging all of them whenever a table is read costs more
the longer the log gets. Here a second stream reads the partials as they arrive and keeps
one merged row per key in Spark's state store. Folds are maxima and minima, so this is a
streaming aggregation: it runs in the JVM, its state is one row per key, and a batch
touches the keys that it names.

Every batch appends the rows whose merged state it changed (`changes`). A value that wins
carries the time of the batch that brought it, so a key that was named again without a new
winner is no change. The current table is the last change of each key; since folds take
repeated input without harm, partials that are delivered again, or were merged by a
compaction, change nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from meetledger.operators.folds import Fold
from meetledger.session import as_stream, prepare
from meetledger.sources.tables import TableStore

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# a batch stores what it changed, and not the whole state again
STATE_CONF = {
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}
CHANGES = "changes"


class StateTable:
    """One folded table as state; ``partials`` names where its partial folds are appended."""

    def __init__(self, spark: SparkSession, fold: Fold, partials: TableStore, name: str) -> None:
        self.spark, self.fold, self.partials, self.name = prepare(spark), fold, partials, name
        # a manifest of its own: the ingest and this stream publish independently
        self.store = TableStore(spark, f"{partials.root}/_state/{name}")

    def start(self, checkpoint: str, **trigger) -> StreamingQuery:
        """Follow the partials, e.g. with ``availableNow=True`` or ``processingTime="1 minute"``."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        for key, value in STATE_CONF.items():
            self.spark.conf.set(key, value)
        schema = T.StructType.fromJson(self.partials.manifest()["tables"][self.name]["schema"])
        arriving = (
            self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.partials.root}/{self.name}")
        )
        writer = self.merged(arriving).writeStream.outputMode("update").foreachBatch(self._on_batch)
        with as_stream(self.spark):
            return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def merged(self, partials: DataFrame) -> DataFrame:
        """Merged state per key; each winner is stamped with the batch that brought it first."""
        now = F.unix_micros(F.current_timestamp())
        columns = {}
        for name, (how, _) in self.fold.columns.items():
            # of equal values the earlier batch wins, so repeated input changes nothing
            stamp = -now if how == "max" else now
            columns[name] = F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("state"), stamp.alias("stamp")))
        stamped = partials.select(*self.fold.keys, now.alias("_now"), *[c.alias(n) for n, c in columns.items()])
        pick = {"max": F.max, "min": F.min}
        winners = [pick[how](name).alias(name) for name, (how, _) in self.fold.columns.items()]
        return stamped.groupBy(*self.fold.keys).agg(F.max("_now").alias("_touched"), *winners)

    def _on_batch(self, rows: DataFrame, batch: int) -> None:
        source = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        commit = self.store.begin(source, batch)
        if commit is None:
            return
        commit.append(CHANGES, self.changed(rows).withColumn("change", F.lit(batch).cast("long")), bucket_by=self.fold.keys)
        commit.publish()

    def changed(self, rows: DataFrame) -> DataFrame:
        """Of the touched rows those with a winner from this very batch."""
        new: list[Column] = [F.coalesce(F.abs(F.col(f"{n}.stamp")) == F.col("_touched"), F.lit(False)) for n in self.fold.columns]
        kept = rows.filter(reduce(lambda a, b: a | b, new))
        return kept.select(*self.fold.keys, *[F.col(f"{n}.state").alias(n) for n in self.fold.columns])

    # --- reading ---

    def changes(self, after: int = -1) -> DataFrame:
        """Keys, ``change`` (the number of the batch) and the merged state after it."""
        return self.store.read(CHANGES).filter(F.col("change") > after)

    def table(self) -> DataFrame:
        """The current rows: what the last change of each key says."""
        return self.fold.result(self._last(self.store.read(CHANGES)))

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The current rows of some keys, read from their buckets."""
        return self.fold.result(self._last(self.store.lookup(CHANGES, keys)))

    def _last(self, changes: DataFrame) -> DataFrame:
        # a result needs the values alone, so when they arrived does not move
        state = F.struct(*[F.struct(F.col(n)["value"].alias("value")).alias(n) for n in self.fold.columns])
        last = changes.groupBy(*self.fold.keys).agg(F.max_by(state, "change").alias("_last"))
        return last.select(*self.fold.keys, *[F.col(f"_last.{n}").alias(n) for n in self.fold.columns])
