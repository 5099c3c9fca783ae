"""Tables the engine keeps: content-addressed objects, snapshots with tombstones, replaced and swapped tables, text sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import ingest


class Store:
    """Versions of named tables under one folder; a pointer file names the current version of each.

    A version is written whole and the pointer replaced by rename, so readers see the old or the new table, never
    a mixture; a failed write leaves the pointer as it was.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}/current")
        if not self._fs.exists(p):
            return None
        return self.spark.read.text(f"{self.root}/{name}/current").first()[0]

    def read(self, name: str) -> DataFrame | None:
        v = self.version(name)
        return None if v is None else self.spark.read.parquet(f"{self.root}/{name}/{v}")

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Write a new version and make it current; the version before is removed afterwards."""
        old, v = self.version(name), uuid.uuid4().hex
        w = df.write
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{self.root}/{name}/{v}")
        self.activate(name, v)
        if old:
            self._fs.delete(self._path(f"{self.root}/{name}/{old}"), True)
        return v

    def activate(self, name: str, version: str) -> None:
        """Point a name to a staged version."""
        tmp = self._path(f"{self.root}/{name}/.{version}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(version.encode()))
        out.close()
        now = self._path(f"{self.root}/{name}/current")
        self._fs.delete(now, False)
        if not self._fs.rename(tmp, now):
            raise RuntimeError(f"{name}: the pointer could not be replaced")


def objects(files: DataFrame, content: str = "content") -> DataFrame:
    """digest, size, content: one row per content."""
    return files.where(F.col(content).isNotNull()).groupBy(T.digest(content).alias("digest")).agg(F.first(content).alias("content")).withColumn("size", F.octet_length("content").cast("long"))


def apply_batch(store: Store, batch: DataFrame, name: str = "snapshot") -> DataFrame:
    """Apply changes (workspace_id, path, op, hash, revision, seq, content) to a stored snapshot.

    Upserts whose hash does not fit their content are refused and returned with the reason.
    """
    ok = (F.col("op") == "delete") | F.col("hash").eqNullSafe(T.digest("content"))
    good = batch.where(ok).withColumn("path", T.normal_path("path")).where("path is not null")
    old = store.read(name)
    new = ingest.latest_state(good) if old is None else ingest.applied(old, good.select(*old.columns))
    store.write(name, new)
    bad = F.when(~ok, "hash_mismatch").when(T.normal_path("path").isNull(), "bad_path")
    return batch.withColumn("reason", bad).where("reason is not null")


def audit(df: DataFrame, path: str, width: int = 200) -> None:
    """Append audit rows (ts, actor, action, target, ip, outcome, extra) as CSV, long fields cut."""
    cols = ["actor", "action", "target", "ip", "outcome", "extra"]
    df.select("ts", *[F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, width).alias(c) for c in cols]).write.mode("append").option("header", "false").csv(path)
