"""Structured Streaming jobs: change batches, watermarks, memories, rate limits, idempotency and logs.

Sources are file streams of a fixed schema; sinks apply micro-batches with ``foreachBatch``. A batch writes by version, so
a batch that runs again after a failure gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.operators import memory, observe
from codeloom.sources.store import Store, apply_batch

CHANGE = "workspace_id string, path string, op string, hash string, revision long, seq long, size long, content string"


def changes(spark: SparkSession, folder: str, files_per_batch: int = 100, schema: str = CHANGE) -> DataFrame:
    """A stream of change files (JSON lines); the bound on files is the bounded queue before the single worker."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def run(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, name: str | None = None):
    """Start a job that takes what is there now and ends; the checkpoint remembers what was taken."""
    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (w.queryName(name) if name else w).start()


def sync(store: Store) -> Callable[[DataFrame, int], None]:
    """Batches onto the snapshot and the accepted revisions (a monotone maximum); refused changes go with their reason to the
    table ``refused``, where one that comes again counts once."""

    def batch(df: DataFrame, n: int) -> None:
        if not df.take(1):
            return
        bad = apply_batch(store, df)
        bad = bad.select("workspace_id", "path", "revision", "seq", "reason")
        before = store.read("refused")
        if bad.take(1):
            store.write("refused", bad if before is None else before.unionByName(bad).distinct())
        seen = df.groupBy("workspace_id").agg(F.max("revision").alias("accepted_revision"))
        old = store.read("watermarks")
        both = seen if old is None else old.unionByName(seen)
        store.write("watermarks", both.groupBy("workspace_id").agg(F.max("accepted_revision").alias("accepted_revision")))

    return batch


def remember(store: Store) -> Callable[[DataFrame, int], None]:
    """Memories stored or bumped by fingerprint."""

    def batch(df: DataFrame, n: int) -> None:
        if df.take(1):
            old = store.read("memories")
            empty = df.limit(0)
            store.write("memories", memory.upsert(empty if old is None else old.select(*empty.columns), df))

    return batch


def limited(stream: DataFrame, identity: str, at: str, order: str, rate: float, burst: float) -> DataFrame:
    """(identity, order, allowed): a token bucket per identity kept as state between micro-batches."""
    x = stream.select(F.col(identity).cast("string").alias("k"), F.col(order).cast("long").alias("o"), F.unix_micros(F.col(at).cast("timestamp")).alias("t")).where("k is not null and t is not null")

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = tuple(state.get) if state.exists else None
        data = pd.concat(list(rows)).sort_values(["t", "o"])
        out = []
        for t in data["t"]:
            ok, bucket = observe.take(bucket, t / 1e6, rate, burst)
            out.append(ok)
        if bucket is not None:
            state.update(bucket)
        yield pd.DataFrame({"k": data["k"], "o": data["o"], "allowed": out})

    return x.groupBy("k").applyInPandasWithState(step, "k string, o long, allowed boolean", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)


def judged(stream: DataFrame, key: str, payload: str, at: str, order: str, ttl_s: int = 86_400) -> DataFrame:
    """(order, outcome) of requests by idempotency key, kept as state until the time to live ends in event time.

    Requests later than the time to live behind the stream's watermark are dropped.
    """
    x = stream.select(F.col(key).cast("string").alias("k"), F.col(payload).cast("string").alias("p"), F.col(order).cast("long").alias("o"), F.col(at).cast("timestamp").alias("at")).where("k is not null and at is not null")
    x = x.withWatermark("at", f"{ttl_s} seconds").withColumn("t", F.unix_micros("at"))

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else None
        data = pd.concat(list(rows)).sort_values(["t", "o"])
        out = []
        for p, t in zip(data["p"], data["t"]):
            result, held = observe.judge(held, p, t / 1e6, ttl_s)
            out.append(result)
        if held is not None:
            state.update(held)
            state.setTimeoutTimestamp(max(int(held[1] * 1000) + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"o": data["o"], "outcome": out})

    return x.groupBy("k").applyInPandasWithState(step, "o long, outcome string", "p string, at double", "append", GroupStateTimeout.EventTimeTimeout)


def deduplicated(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key within a watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, size: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and keys, late rows within the delay included."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, at: str, gap: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Counts per session of each key."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch to several sinks, read once. A sink that fails does not keep the batch from the others; the first failure
    is raised after all had it, so that the batch comes again."""

    def batch(df: DataFrame, n: int) -> None:
        df.persist()
        failed: list[Exception] = []
        try:
            for sink in sinks:
                try:
                    sink(df, n)
                except Exception as e:  # noqa: BLE001
                    failed.append(e)
        finally:
            df.unpersist()
        if failed:
            raise failed[0]

    return batch


class Job:
    """A job over parts of a table that can stop and go on: each part's rows are staged under the part's number, and a table
    names the parts that are done; when all are, the staged rows become the table ``name`` at once.

    The state is 'running', 'paused', 'cancelled' or 'done' and lies in the store, so any driver can read or change it
    between parts. A part that was staged by a driver that died before it could say so is made again.
    """

    def __init__(self, store: Store, name: str, parts: int):
        self.store, self.name, self.parts = store, name, parts

    def state(self) -> str | None:
        s = self.store.read(f"{self.name}_state")
        return None if s is None else s.first()["state"]

    def set(self, state: str) -> None:
        self.store.write(f"{self.name}_state", self.store.spark.createDataFrame([(state,)], "state string"))

    def done(self) -> set[int]:
        """Parts that are staged (at most ``parts`` rows)."""
        d = self.store.read(f"{self.name}_done")
        return set() if d is None else {r["part"] for r in d.collect()}

    def run(self, rows: DataFrame, keys: list[str], fn: Callable[[DataFrame], DataFrame], fresh: bool = False) -> str:
        """Go on from what is done; rows fall into parts by hash of the keys. Returns the state at the end."""
        spark = self.store.spark
        if fresh or self.state() in (None, "cancelled", "done"):
            self.store.write(f"{self.name}_done", spark.createDataFrame([], "part int"))
        self.set("running")
        done = self.done()
        part_of = F.pmod(F.xxhash64(*keys), F.lit(self.parts)).cast("int")
        for part in range(self.parts):
            if part in done:
                continue
            if self.state() != "running":
                return self.state()
            self.store.write(f"{self.name}_staged_{part}", fn(rows.where(part_of == part)))
            done.add(part)
            self.store.write(f"{self.name}_done", spark.createDataFrame([(p,) for p in sorted(done)], "part int"))
        if self.state() == "running":
            out = None
            for part in range(self.parts):
                staged = self.store.read(f"{self.name}_staged_{part}")
                out = staged if out is None else out.unionByName(staged)
            self.store.write(self.name, out)
            self.set("done")
        return self.state()
