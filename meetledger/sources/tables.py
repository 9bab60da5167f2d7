"""Table storage with atomic multi-table commits, on plain parquet.

Every commit writes its tables under ``<table>/commit=<n>``; readers see only commits
listed in a small manifest file, which is replaced in one rename. A commit that failed
half way is not listed, and the next attempt overwrites its folders. A commit may name
the stream and batch it stands for, so that a batch delivered again is recognised.

A table may be laid out in buckets by the hash of a key. Rows of given keys are then found
by reading the buckets of these keys alone; see :meth:`TableStore.lookup`.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meetledger.session import PACKED

MANIFEST = "_manifest.json"
BUCKETS = 64
# so many keys at most are looked up by value, which lets Bloom filters of the files decide
LITERAL_KEYS = 500
_BUCKET = "_bucket"

def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bloom_filters(keys: Sequence[str]) -> dict[str, str]:
    """Write options: a filter tells of most keys that a file does not hold them.

    Its size, one of ten from 2 kB to 1 MB, follows the number of keys in the file.
    """
    options = {"parquet.bloom.filter.adaptive.enabled": "true"}
    for key in keys:
        options |= {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.candidates.number#{key}": "10"}
    return options


class Commit:
    """Tables written together; nothing is visible before :meth:`publish`."""

    def __init__(self, store: TableStore, manifest: dict, source: str | None, batch: int | None) -> None:
        self.store = store
        self.number = manifest["commit"] + 1
        self._manifest = {**manifest, "commit": self.number, "tables": dict(manifest["tables"])}
        if source is not None:
            self._manifest["batches"] = {**manifest["batches"], source: batch}

    def append(self, table: str, frame: DataFrame, bucket_by: Sequence[str] = ()) -> DataFrame:
        """Write the rows and return them as stored.

        ``bucket_by`` names the key of a table when it is first written; later writes keep to it.
        """
        return self._write(table, frame, keep=True, bucket_by=bucket_by)

    def replace(self, table: str, frame: DataFrame) -> DataFrame:
        """Write the rows in place of what the table holds."""
        return self._write(table, frame, keep=False)

    def _write(self, table: str, frame: DataFrame, keep: bool, bucket_by: Sequence[str] = ()) -> DataFrame:
        folder = self.store.folder(table, self.number)
        entry = self._manifest["tables"].get(table)
        layout = entry.get("layout") if entry else None
        if layout is None and bucket_by:
            layout = {"keys": list(bucket_by), "buckets": self.store.buckets}
        if layout:
            dealt = frame.withColumn(_BUCKET, bucket_of(layout["keys"], layout["buckets"])).repartition(_BUCKET)
            # in order of the key, which the writer's own sort by bucket then has done: like rows lie together
            dealt = dealt.sortWithinPartitions(_BUCKET, *layout["keys"])
            dealt.write.mode("overwrite").options(**PACKED, **bloom_filters(layout["keys"])).partitionBy(_BUCKET).parquet(folder)
        else:
            frame.write.mode("overwrite").options(**PACKED).parquet(folder)
        before = entry["commits"] if entry and keep else []
        self._manifest["tables"][table] = {"commits": [*before, self.number], "schema": json.loads(frame.schema.json()), "layout": layout}
        return self.store.spark.read.schema(frame.schema).option("recursiveFileLookup", "true").parquet(folder)

    def publish(self) -> int:
        self.store.swap_manifest(self._manifest)
        return self.number


class TableStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    # --- manifest: last commit, last batch by stream, and commits and schema by table ---

    def _context(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark._jsc.hadoopConfiguration()
        return jvm, target, jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)

    def manifest(self) -> dict:
        jvm, path, context = self._context(f"{self.root}/{MANIFEST}")
        if not context.util().exists(path):
            return {"commit": -1, "batches": {}, "tables": {}}
        stream = context.open(path)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def swap_manifest(self, manifest: dict) -> None:
        jvm, path, context = self._context(f"{self.root}/{MANIFEST}")
        _, draft, _ = self._context(f"{self.root}/{MANIFEST}.{manifest['commit']}")
        flags = jvm.java.util.EnumSet.of(
            jvm.org.apache.hadoop.fs.CreateFlag.CREATE, jvm.org.apache.hadoop.fs.CreateFlag.OVERWRITE
        )
        parents = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
        options[0] = parents
        out = context.create(draft, flags, options)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, path, rename)

    # --- reading and writing ---

    def folder(self, table: str, number: int) -> str:
        return f"{self.root}/{table}/commit={number}"

    def tables(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def read(self, table: str) -> DataFrame | None:
        """The published rows of a table, or None when it was never written."""
        entry = self.manifest()["tables"].get(table)
        if entry is None:
            return None
        schema = T.StructType.fromJson(entry["schema"])
        folders = [self.folder(table, n) for n in entry["commits"]]
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders)

    def lookup(self, table: str, keys: DataFrame) -> DataFrame | None:
        """The rows of a bucketed table whose key is among ``keys``, read from their buckets alone.

        A few keys are passed by value, so that the scan names its buckets and the Bloom
        filters of the files are asked; more keys are joined, and Spark prunes the buckets
        at run time by those of the keys.
        """
        entry = self.manifest()["tables"].get(table)
        if entry is None:
            return None
        found = self.by_value(table, keys)
        if found is not None:
            return found
        names, buckets = entry["layout"]["keys"], entry["layout"]["buckets"]
        wanted = keys.select(*names, bucket_of(names, buckets).alias(_BUCKET)).distinct()
        return self._bucketed(table, entry).join(wanted, [*names, _BUCKET], "left_semi").drop(_BUCKET)

    def by_value(self, table: str, keys: DataFrame) -> DataFrame | None:
        """The rows of a few keys, which the scan is given by value; None for more keys, or no table."""
        entry = self.manifest()["tables"].get(table)
        if entry is None or len(entry["layout"]["keys"]) > 1:
            return None
        (name,), buckets = entry["layout"]["keys"], entry["layout"]["buckets"]
        wanted = keys.select(name, bucket_of([name], buckets).alias(_BUCKET))
        # a look at some rows tells of most large batches that their keys are many
        if len(set(wanted.limit(2 * LITERAL_KEYS).collect())) > LITERAL_KEYS:
            return None
        few = wanted.distinct().limit(LITERAL_KEYS + 1).collect()
        if len(few) > LITERAL_KEYS:
            return None
        self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(LITERAL_KEYS))
        hit = F.col(_BUCKET).isin(sorted({r[_BUCKET] for r in few})) & F.col(name).isin([r[0] for r in few])
        return self._bucketed(table, entry).filter(hit).drop(_BUCKET)

    def _bucketed(self, table: str, entry: dict) -> DataFrame:
        schema = T.StructType([*T.StructType.fromJson(entry["schema"]).fields, T.StructField(_BUCKET, T.IntegerType())])
        folders = [self.folder(table, n) for n in entry["commits"]]
        # below the folder of the table both commit and bucket are partitions
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*folders).drop("commit")

    def begin(self, source: str | None = None, batch: int | None = None) -> Commit | None:
        """A new commit, or None when this batch of this stream is published already."""
        manifest = self.manifest()
        if source is not None and batch <= manifest["batches"].get(source, -1):
            return None
        return Commit(self, manifest, source, batch)

    def save(self, tables: dict[str, DataFrame]) -> int:
        """Replace several tables in one commit."""
        commit = self.begin()
        for name, frame in tables.items():
            commit.replace(name, frame)
        return commit.publish()
