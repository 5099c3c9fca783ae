"""Incremental ingestion: change detection, batches, coalescing, watermarks, freshness, readiness and policy.

A change is a row (workspace_id, path, op 'upsert' or 'delete', hash, revision, seq). Order within equal revisions
is by seq. Everything is an equi-join, an anti-join or an aggregate per (workspace, path), so hot workspaces spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.ordered import cut_sequences
from codeloom.session import Scratch

KEYS = ["workspace_id", "path"]


def changes(current: DataFrame, known: DataFrame, keys: list[str] = KEYS, value: str = "hash") -> DataFrame:
    """keys.., change: 'new', 'modified', 'deleted' or 'same', by a full outer join on the keys."""
    a = current.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = known.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    kind = F.when(F.col("_in_b").isNull(), "new").when(F.col("_in_a").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("modified")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("change"))


def unchanged_skipped(batch: DataFrame, known: DataFrame, keys: list[str] = KEYS, value: str = "hash") -> DataFrame:
    """The rows of a batch whose content is not stored yet."""
    return batch.join(known.select(*keys, value).distinct(), [*keys, value], "left_anti")


def latest_state(log: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The last change per key."""
    rest = [c for c in log.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("revision", "seq"))
    return log.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def applied(state: DataFrame, batch: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """State after a batch: the last change per key wins, a delete stays as a tombstone row."""
    return latest_state(state.unionByName(batch), keys)


def live(state: DataFrame) -> DataFrame:
    return state.where("op <> 'delete'")


def coalesced(log: DataFrame, max_files: int = 25, max_bytes: int = 250_000) -> DataFrame:
    """The last change per key with the batch it falls into: deletes cancel earlier upserts, and a batch of a workspace
    ends where the next item would exceed its number or its bytes; the first item is always admitted. Deletes take
    no bytes."""
    x = latest_state(log).withColumn("_room", F.when(F.col("op") != "delete", F.coalesce("size", F.lit(0))))
    return cut_sequences(x, ["workspace_id"], ["revision", "seq", "path"], "_room", max_files, max_bytes, "batch", Scratch(log.sparkSession)).drop("_room")


def debounced(events: DataFrame, keys: list[str], at: str, seq: str, op: str, gap_ms: int = 800) -> DataFrame:
    """keys.., burst (from 0), begun, ended, events, op: events of a key closer than ``gap_ms`` to the one before are one
    burst, which counts with its last operation. Times in milliseconds; a null time is before all others."""
    over = "over (partition by " + ", ".join(f"`{k}`" for k in keys) + f" order by `{at}`, `{seq}`)"
    x = events.withColumn("_lag", F.expr(f"lag(`{at}`) {over}")).withColumn("_new", F.when(F.col("_lag").isNull() | (F.col(at) - F.col("_lag") > gap_ms), 1).otherwise(0))
    x = x.withColumn("burst", (F.expr(f"sum(_new) {over}") - 1).cast("long"))
    return x.groupBy(*keys, "burst").agg(F.min(at).alias("begun"), F.max(at).alias("ended"), F.count("*").alias("events"), F.max_by(op, F.struct(at, seq)).alias("op"))


def queue_state(log: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys.., revision, accepted_revision, failures, state: of a log of events 'add', 'ack' and 'fail' with revisions, what
    is accepted at its newest revision, to be tried again after failures, or still pending; in any order of arrival."""
    of = lambda e: F.when(F.col("event") == e, F.col("revision"))
    x = log.groupBy(*keys).agg(F.max(of("add")).alias("revision"), F.max(of("ack")).alias("accepted_revision"), F.count_if(F.col("event") == "fail").alias("failures"))
    return x.withColumn("state", F.when(F.col("accepted_revision") >= F.col("revision"), "accepted").when(F.col("failures") > 0, "retry").otherwise("pending"))


def watermarks(log: DataFrame) -> DataFrame:
    """Accepted revision per workspace: the greatest seen, whatever the order of arrival."""
    return log.groupBy("workspace_id").agg(F.max("revision").alias("accepted_revision"), F.countDistinct("path").alias("paths"))


def counted_on(counts: DataFrame, gone: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., n: counts carried on by the rows that an update takes away and adds, without reading the rest again; keys
    that fall to 0 are left out."""
    d = counts.select(*keys, "n").unionByName(new.groupBy(*keys).agg(F.count("*").alias("n"))).unionByName(gone.groupBy(*keys).agg((-F.count("*")).alias("n")))
    return d.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def assigned(batches: DataFrame, accepted: DataFrame) -> DataFrame:
    """New revision of each batch: one more than the accepted one, or the client's if that is greater (late ones are
    still taken)."""
    x = batches.join(accepted.select("workspace_id", "accepted_revision"), "workspace_id", "left")
    return x.withColumn("new_revision", F.greatest(F.coalesce("accepted_revision", F.lit(0)) + 1, F.coalesce("client_revision", F.lit(0))))


def freshness(status: DataFrame, required: str = "min_revision") -> DataFrame:
    """``status`` with semantic_fresh, exact_fresh, snapshot_fresh and freshness, the best that holds. Columns:
    accepted_revision, semantic_revision, exact_revision, exact_only, and the revision required."""
    need = F.greatest(F.col(required), F.col("accepted_revision"))
    x = status.withColumn("semantic_fresh", (F.col("semantic_revision") >= need) & ~F.col("exact_only")).withColumn("exact_fresh", F.col("exact_revision") >= need).withColumn("snapshot_fresh", F.col("accepted_revision") >= F.col(required))
    return x.withColumn("freshness", F.when(F.col("semantic_fresh"), "fresh").when(F.col("exact_fresh"), "exact_fresh").when(F.col("snapshot_fresh"), "snapshot_fresh").otherwise("stale"))


#: Coverages with which semantic answers are complete enough.
READY_COVERAGES = ["full", "filtered", "selected_files", "complete"]


def readiness(status: DataFrame) -> DataFrame:
    """``status`` with exact_ready, semantic_ready, mode (of a query) and reason. Columns: files, deletes, accepted_revision,
    exact_revision, exact_files, semantic_revision, coverage, exact_only, busy, error."""
    snap = (F.col("files") > 0) | (F.col("accepted_revision") > 0) | (F.col("deletes") > 0)
    exact = snap & (F.col("exact_files") > 0) & (F.col("exact_revision") >= F.col("accepted_revision"))
    bad = F.col("error").isNotNull()
    semantic = snap & (F.col("semantic_revision") >= F.col("accepted_revision")) & ~F.col("busy") & ~bad & ~F.col("exact_only") & F.col("coverage").isin(READY_COVERAGES)
    behind = F.col("busy") | (F.col("accepted_revision") > F.col("semantic_revision"))
    reason = (
        F.when(~snap, "empty_workspace").when(~exact, "exact_index_catching_up").when(semantic, F.col("coverage")).when(F.col("exact_only"), "exact_only_initial_sync").when(bad, "index_error")
        .when(behind, "semantic_index_catching_up").when(F.col("coverage") == "filtered_empty", "semantic_filtered_empty")
        .when(F.col("coverage").isin("deletes_only", "unchanged", "unknown"), F.concat(F.lit("semantic_"), "coverage")).otherwise("semantic_not_ready")
    )
    mode = F.when(semantic, "semantic_first").when(exact, "exact_first").when(snap, "snapshot_only").otherwise("local_only")
    return status.withColumn("exact_ready", exact).withColumn("semantic_ready", semantic).withColumn("mode", mode).withColumn("reason", reason)


#: Fixed values of the indexing policy.
SUFFIXES = ["bash", "c", "cc", "cfg", "cpp", "cs", "cxx", "go", "h", "hpp", "java", "js", "jsx", "kt", "kts", "md", "php", "py", "pyi", "rb", "rs", "rst", "scala", "sh", "swift", "toml", "ts", "tsx", "yaml", "yml", "zsh"]
FILE_NAMES = ["dockerfile", "gemfile", "justfile", "makefile", "procfile", "rakefile"]
EXCLUDED_PARTS = [".cache", ".git", ".hg", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "build", "coverage", "dist", "fixtures", "locale", "node_modules", "site-packages", "static", "target", "third_party", "vendor", "vendors", "__pycache__"]
EXCLUDED_ENDS = [".min.css", ".min.js", ".bundle.js", ".bundle.css"]
TEST_PARTS = ["__tests__", "spec", "specs", "test", "tests", "testing"]
LOW_TEST_PARTS = ["benchmark", "benchmarks", "ducktape", "e2e", "end-to-end", "integration-test", "integration-tests", "integration_test", "integration_tests", "perf", "performance", "smoke-test", "smoke-tests", "system-test", "system-tests", "system_test", "system_tests"]
LOW_TEST_WORDS = ["bench", "ducktape", "e2e", "integration", "perf", "smoke", "system"]
MAX_BYTES, TEST_MAX_BYTES, MAX_CHUNKS, TEST_MAX_CHUNKS = 500_000, 160_000, 32, 12


def path_category(path: str | Column) -> Column:
    """'low_value_test', 'test' or 'source', by the parts of a path."""
    parts = F.split(F.lower(F.col(path) if isinstance(path, str) else path), "/")

    def has(words: list[str]) -> Column:
        return F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words]))

    def low(p: Column) -> Column:
        c = F.translate(p, "_", "-")
        return c.contains("test") & reduce(lambda a, b: a | b, [c.contains(w) for w in LOW_TEST_WORDS])

    return F.when(has(LOW_TEST_PARTS) | F.exists(parts, low), "low_value_test").when(has(TEST_PARTS) | F.exists(parts, lambda p: p.endswith("tests") | p.endswith("-test")), "test").otherwise("source")


def index_policy(path: str, size: Column, phase: str = "") -> tuple[Column, Column]:
    """(included, reason): the first rule that holds excludes; ``size`` is in bytes."""
    parts = F.split(F.lower(path), "/")
    name = F.lower(T.basename(path))
    category = path_category(path)
    test = category != "source"
    excluded = F.arrays_overlap(parts, F.array(*[F.lit(p) for p in EXCLUDED_PARTS])) | reduce(lambda a, b: a | b, [name.endswith(e) for e in EXCLUDED_ENDS])
    reason = F.when(excluded, "path_excluded")
    if phase == "semantic_full_bootstrap":
        reason = reason.when(test, "semantic_test_path_limited_bootstrap")
    reason = reason.when(category == "low_value_test", "semantic_low_value_test_path").when(test & (size > TEST_MAX_BYTES), "semantic_test_file_too_large")
    reason = reason.when(~T.suffix(path).isin(SUFFIXES) & ~name.isin(FILE_NAMES), "extension_not_enabled").when(size > MAX_BYTES, "file_too_large").otherwise("included")
    return reason == "included", reason


def merged_coverage(df: DataFrame, keys: list[str], coverage: str) -> DataFrame:
    """keys.., coverage: one coverage for the set of a group, by priority."""
    known = F.array_remove(F.collect_set(F.when(~F.col(coverage).isin("", "unknown"), F.col(coverage))), "unknown")
    g = df.groupBy(*keys).agg(known.alias("_c"))

    def has(x: str) -> Column:
        return F.array_contains("_c", x)

    first = has("exact_only_initial_sync")
    out = (
        F.when(F.size("_c") == 0, "unknown").when(first & has("selected_files"), "selected_files").when(first & has("filtered"), "filtered").when(first & (F.size("_c") > 1), "partial_after_exact_only").when(first, "exact_only_initial_sync")
        .when(has("filtered"), "filtered").when(has("selected_files"), "selected_files").when(has("filtered_empty"), "filtered_empty").when(has("deletes_only"), "deletes_only").otherwise(F.array_min("_c"))
    )
    return g.select(*keys, out.alias("coverage"))


def chunk_limited(chunks: DataFrame, key: list[str], path: str, order: list[str]) -> DataFrame:
    """At most 32 chunks of a file, 12 of a test file, in order."""
    part = ", ".join(f"`{k}`" for k in key)
    n = F.expr(f"row_number() over (partition by {part} order by {', '.join(order)})")
    most = F.when(path_category(path) == "source", MAX_CHUNKS).otherwise(TEST_MAX_CHUNKS)
    return chunks.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def routed(accepted: Column, local: Column, exact: Column, needs: str) -> Column:
    """Where a query of a kind runs: 'cloud' if what it needs is as new as the local revision, 'cloud_exact' if at least the
    exact index is, else 'local'."""
    ok = accepted >= local
    return F.when(ok & (F.lit(needs) == "snapshot"), "cloud").when((exact >= local) & (F.lit(needs) == "exact"), "cloud").when(exact >= local, "cloud_exact").otherwise("local")
