"""Queries of ingestion, observability, projects and transformations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import planner
from codeloom.functions import text as T
from codeloom.operators import ingest, observe, project, transform
from codeloom.plans.base import DOC_LINES, KEYS, LINES, SNAP, SQL, doc_lines, file_lines, query, snapshot
from codeloom.plans.retrieval import _TEST_LIKE, SYMBOLS
from codeloom.session import table

# Ingestion


@query
def change_detect(spark, d):
    """Pushed snapshot against the index."""
    known = table(spark, d, "files").groupBy(*KEYS).agg(F.max_by("hash", F.struct("revision", "hash")).alias("hash"))
    return ingest.changes(snapshot(spark, d), known)


_KNOWN = "known AS (SELECT workspace_id, path, hash FROM files QUALIFY row_number() OVER (PARTITION BY workspace_id, path ORDER BY revision DESC, hash DESC) = 1)"
SQL["change_detect"] = f"""WITH {SNAP}, {_KNOWN} SELECT coalesce(s.workspace_id, k.workspace_id) AS workspace_id, coalesce(s.path, k.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'deleted' WHEN s.hash IS NOT DISTINCT FROM k.hash THEN 'same' ELSE 'modified' END AS change
FROM snap s FULL OUTER JOIN known k ON s.workspace_id = k.workspace_id AND s.path = k.path"""


@query
def skip_unchanged(spark, d):
    """Pushed rows whose content the index does not hold."""
    f = table(spark, d, "sync_files").select("sync_id", *KEYS, "hash")
    return ingest.unchanged_skipped(f, table(spark, d, "files"))


SQL["skip_unchanged"] = "SELECT sync_id, workspace_id, path, hash FROM sync_files s WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.workspace_id = s.workspace_id AND f.path = s.path AND f.hash = s.hash)"


def _log(spark, d):
    f = table(spark, d, "sync_files")
    op = F.when(F.col("content") == "", "delete").otherwise("upsert")
    return f.select(*KEYS, op.alias("op"), "hash", "revision", F.col("sync_id").alias("seq"), "size")


def _timed(spark, d):
    f = table(spark, d, "sync_files")
    op = F.when(F.col("content") == "", "delete").otherwise("upsert")
    return f.select(*KEYS, op.alias("op"), F.col("sync_id").alias("seq"), F.unix_millis("received_at").alias("at"))


@query
def latest_per_key(spark, d):
    """State after applying one half of the pushes onto the other; empty contents are deletes."""
    log = _log(spark, d)
    return ingest.live(ingest.applied(log.where("seq % 2 = 0"), log.where("seq % 2 = 1"))).select(*KEYS, "hash", "revision")


SQL["latest_per_key"] = "SELECT workspace_id, path, hash, revision FROM (SELECT * FROM sync_files QUALIFY row_number() OVER (PARTITION BY workspace_id, path ORDER BY revision DESC, sync_id DESC) = 1) WHERE content IS NULL OR content <> ''"


@query
def coalesce_batches(spark, d):
    """Coalesced changes and the batches they fall into."""
    return ingest.coalesced(_log(spark, d)).select(*KEYS, "op", "revision", "batch")


SQL["coalesce_batches"] = """WITH RECURSIVE l AS (SELECT workspace_id, path, CASE WHEN content = '' THEN 'delete' ELSE 'upsert' END AS op, revision, sync_id AS seq, CASE WHEN content = '' THEN NULL ELSE greatest(coalesce(size, 0), 0) END AS size FROM sync_files QUALIFY row_number() OVER (PARTITION BY workspace_id, path ORDER BY revision DESC, sync_id DESC) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY revision, seq, path) AS n FROM l),
cut(workspace_id, n, items, bytes, batch) AS (SELECT workspace_id, n, 1, coalesce(size, 0), 0::BIGINT FROM n WHERE n = 1
UNION ALL SELECT n.workspace_id, n.n, CASE WHEN items >= 25 OR bytes + n.size > 250000 THEN 1 ELSE items + 1 END, CASE WHEN items >= 25 OR bytes + n.size > 250000 THEN coalesce(n.size, 0) ELSE bytes + coalesce(n.size, 0) END, CASE WHEN items >= 25 OR bytes + n.size > 250000 THEN batch + 1 ELSE batch END
FROM cut JOIN n ON n.workspace_id = cut.workspace_id AND n.n = cut.n + 1)
SELECT n.workspace_id, n.path, n.op, n.revision, batch FROM n JOIN cut ON n.workspace_id = cut.workspace_id AND n.n = cut.n"""


@query
def watermark(spark, d):
    """Accepted revision per workspace."""
    return ingest.watermarks(table(spark, d, "sync_files"))


SQL["watermark"] = "SELECT workspace_id, max(revision) AS accepted_revision, count(DISTINCT path) AS paths FROM sync_files GROUP BY workspace_id"


@query
def delta_counts(spark, d):
    """Chunks per workspace after half of the files changed, from the counts before and the changed rows alone."""
    c = table(spark, d, "chunks").select("workspace_id", "faiss_id")
    old, new = c.where("faiss_id % 2 = 0"), c.where("faiss_id % 3 = 0")
    before = c.where("faiss_id % 3 <> 0").groupBy("workspace_id").agg(F.count("*").alias("n"))
    return ingest.counted_on(before, old.where("faiss_id % 3 <> 0"), new, ["workspace_id"])


SQL["delta_counts"] = "SELECT workspace_id, count(*) AS n FROM chunks WHERE faiss_id % 3 = 0 OR faiss_id % 2 <> 0 GROUP BY 1"


@query
def batch_revision(spark, d):
    """Revisions given to one batch per client, late ones included."""
    f = table(spark, d, "sync_files")
    b = f.where("client_id is not null").groupBy("workspace_id", "client_id").agg(F.min("revision").alias("client_revision"))
    return ingest.assigned(b, ingest.watermarks(f)).select("workspace_id", "client_id", "new_revision")


SQL["batch_revision"] = "SELECT s.workspace_id, client_id, greatest(any_value(a) + 1, min(revision)) AS new_revision FROM sync_files s JOIN (SELECT workspace_id, max(revision) AS a FROM sync_files GROUP BY 1) m ON m.workspace_id = s.workspace_id WHERE client_id IS NOT NULL GROUP BY ALL"


def _status(spark, d):
    w = ingest.watermarks(table(spark, d, "sync_files"))
    x = table(spark, d, "files").groupBy("workspace_id").agg(F.max("revision").alias("exact_revision"), F.count("*").alias("exact_files"))
    c = table(spark, d, "chunks").groupBy("workspace_id").agg(F.count("*").alias("chunks"))
    s = w.join(x, "workspace_id", "left").join(c, "workspace_id", "left").na.fill(0)
    return s.select("workspace_id", "accepted_revision", "exact_revision", "exact_files", F.when(F.col("chunks") > 20, F.col("exact_revision")).otherwise(0).alias("semantic_revision"), F.col("paths").alias("files"), F.lit(0).alias("deletes"), (F.col("chunks") % 7 == 0).alias("exact_only"), (F.col("chunks") % 5 == 0).alias("busy"), F.lit(None).cast("string").alias("error"), F.when(F.col("chunks") > 20, "filtered").otherwise("unknown").alias("coverage"))


_STATUS = """st0 AS (SELECT w.workspace_id, w.accepted_revision, coalesce(x.exact_revision, 0) AS exact_revision, coalesce(x.exact_files, 0) AS exact_files, coalesce(c.chunks, 0) AS chunks, w.paths AS files FROM (SELECT workspace_id, max(revision) AS accepted_revision, count(DISTINCT path) AS paths FROM sync_files GROUP BY 1) w
LEFT JOIN (SELECT workspace_id, max(revision) AS exact_revision, count(*) AS exact_files FROM files GROUP BY 1) x ON x.workspace_id = w.workspace_id LEFT JOIN (SELECT workspace_id, count(*) AS chunks FROM chunks GROUP BY 1) c ON c.workspace_id = w.workspace_id),
st AS (SELECT *, CASE WHEN chunks > 20 THEN exact_revision ELSE 0 END AS semantic_revision, chunks % 7 = 0 AS exact_only, chunks % 5 = 0 AS busy, CASE WHEN chunks > 20 THEN 'filtered' ELSE 'unknown' END AS coverage FROM st0)"""


@query
def freshness(spark, d):
    """H7/H8: the best freshness that holds for the accepted revision."""
    s = _status(spark, d).withColumn("min_revision", F.col("accepted_revision"))
    return ingest.freshness(s).select("workspace_id", "semantic_fresh", "exact_fresh", "freshness")


SQL["freshness"] = f"WITH {_STATUS} SELECT workspace_id, semantic_revision >= accepted_revision AND NOT exact_only AS semantic_fresh, exact_revision >= accepted_revision AS exact_fresh, CASE WHEN semantic_revision >= accepted_revision AND NOT exact_only THEN 'fresh' WHEN exact_revision >= accepted_revision THEN 'exact_fresh' ELSE 'snapshot_fresh' END AS freshness FROM st"


@query
def readiness(spark, d):
    """H9: readiness, query mode and its reason."""
    return ingest.readiness(_status(spark, d)).select("workspace_id", "exact_ready", "semantic_ready", "mode", "reason")


SQL["readiness"] = f"""WITH {_STATUS}, r AS (SELECT *, exact_files > 0 AND exact_revision >= accepted_revision AS exact_ready, semantic_revision >= accepted_revision AND NOT busy AND NOT exact_only AND coverage = 'filtered' AS semantic_ready FROM st)
SELECT workspace_id, exact_ready, semantic_ready, CASE WHEN semantic_ready THEN 'semantic_first' WHEN exact_ready THEN 'exact_first' ELSE 'snapshot_only' END AS mode,
CASE WHEN NOT exact_ready THEN 'exact_index_catching_up' WHEN semantic_ready THEN coverage WHEN exact_only THEN 'exact_only_initial_sync' WHEN busy OR accepted_revision > semantic_revision THEN 'semantic_index_catching_up' ELSE 'semantic_unknown' END AS reason FROM r"""


@query
def policy_case(spark, d):
    """Why pushed files are indexed or not."""
    included, reason = ingest.index_policy("path", F.octet_length(F.coalesce("content", F.lit(""))))
    x = table(spark, d, "sync_files").select("workspace_id", included.alias("included"), reason.alias("reason"), ingest.path_category("path").alias("category"))
    return x.groupBy("workspace_id", "included", "reason", "category").agg(F.count("*").alias("n"))


def _in(words):
    return ", ".join(f"'{w}'" for w in words)


_CATEGORY = f"CASE WHEN len(list_intersect(parts, [{_in(ingest.LOW_TEST_PARTS)}])) > 0 OR len(list_filter(parts, lambda p: instr(p, 'test') > 0 AND regexp_matches(replace(p, '_', '-'), '{'|'.join(ingest.LOW_TEST_WORDS)}'))) > 0 THEN 'low_value_test' WHEN len(list_intersect(parts, [{_in(ingest.TEST_PARTS)}])) > 0 OR len(list_filter(parts, lambda p: p LIKE '%tests' OR p LIKE '%-test')) > 0 THEN 'test' ELSE 'source' END"
SQL["policy_case"] = f"""WITH p AS (SELECT workspace_id, string_split(lower(path), '/') AS parts, strlen(coalesce(content, '')) AS size FROM sync_files), c AS (SELECT *, {_CATEGORY} AS category, parts[-1] AS name FROM p),
r AS (SELECT *, CASE WHEN len(list_intersect(parts, [{_in(ingest.EXCLUDED_PARTS)}])) > 0 OR regexp_matches(name, '(\\.min\\.css|\\.min\\.js|\\.bundle\\.js|\\.bundle\\.css)$') THEN 'path_excluded' WHEN category = 'low_value_test' THEN 'semantic_low_value_test_path' WHEN category <> 'source' AND size > 160000 THEN 'semantic_test_file_too_large'
WHEN regexp_extract(name, '^.+\\.([^.]+)$', 1) NOT IN ({_in(ingest.SUFFIXES)}) AND name NOT IN ({_in(ingest.FILE_NAMES)}) THEN 'extension_not_enabled' WHEN size > 500000 THEN 'file_too_large' ELSE 'included' END AS reason FROM c)
SELECT workspace_id, reason = 'included' AS included, reason, category, count(*) AS n FROM r GROUP BY ALL"""


@query
def coverage_merge(spark, d):
    """One coverage per workspace."""
    x = table(spark, d, "documents").select("workspace_id", F.when(F.col("doc_kind") == "issue", "filtered").when(F.col("doc_kind") == "chat", "filtered_empty").when(F.col("doc_kind") == "mail", "exact_only_initial_sync").otherwise("unknown").alias("coverage"))
    return ingest.merged_coverage(x, ["workspace_id"], "coverage")


SQL["coverage_merge"] = """WITH s AS (SELECT workspace_id, bool_or(doc_kind = 'issue') AS f, bool_or(doc_kind = 'chat') AS e, bool_or(doc_kind = 'mail') AS i FROM documents GROUP BY 1)
SELECT workspace_id, CASE WHEN i AND f THEN 'filtered' WHEN i AND e THEN 'partial_after_exact_only' WHEN i THEN 'exact_only_initial_sync' WHEN f THEN 'filtered' WHEN e THEN 'filtered_empty' ELSE 'unknown' END AS coverage FROM s"""


@query
def chunk_limit(spark, d):
    """Chunks that the limits per file keep."""
    c = table(spark, d, "chunks").select("workspace_id", "file_path", "faiss_id")
    return ingest.chunk_limited(c, ["workspace_id", "file_path"], "file_path", ["faiss_id"])


SQL["chunk_limit"] = f"SELECT workspace_id, file_path, faiss_id FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, file_path ORDER BY faiss_id) AS n, string_split(lower(file_path), '/') AS parts FROM chunks) WHERE n <= CASE WHEN {_CATEGORY} = 'source' THEN 32 ELSE 12 END"


@query
def vector_ids(spark, d):
    """SK2: one vector per chunk id, the last added, with its length before normalising."""
    c = table(spark, d, "chunks").select("chunk_id", "workspace_id", "faiss_id", "embedding")
    c = c.groupBy("workspace_id", "chunk_id").agg(F.max_by(F.struct("faiss_id", "embedding"), "faiss_id").alias("r"))
    return c.select("workspace_id", "chunk_id", F.col("r.faiss_id").alias("faiss_id"), F.round(F.sqrt(T.dot(F.col("r.embedding"), F.col("r.embedding"))), 5).alias("length"))


SQL["vector_ids"] = "SELECT workspace_id, chunk_id, faiss_id, round(sqrt(coalesce(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), CASE WHEN embedding IS NOT NULL THEN 0 END)), 5) AS length FROM chunks QUALIFY row_number() OVER (PARTITION BY workspace_id, chunk_id ORDER BY faiss_id DESC) = 1"


@query
def delete_by_file(spark, d):
    """SK3: chunks left after deleting those of files that the index no longer holds at their newest hash."""
    stale = ingest.changes(snapshot(spark, d), table(spark, d, "files").groupBy(*KEYS).agg(F.max_by("hash", F.struct("revision", "hash")).alias("hash"))).where("change <> 'same'")
    return table(spark, d, "chunks").select("faiss_id", "workspace_id", F.col("file_path").alias("path")).join(stale.select(*KEYS), KEYS, "left_anti").select("faiss_id")


SQL["delete_by_file"] = f"WITH {SNAP}, {_KNOWN} SELECT faiss_id FROM chunks c WHERE EXISTS (SELECT 1 FROM snap s JOIN known k ON s.workspace_id = k.workspace_id AND s.path = k.path WHERE s.hash IS NOT DISTINCT FROM k.hash AND s.workspace_id = c.workspace_id AND s.path = c.file_path) OR NOT EXISTS (SELECT 1 FROM (SELECT workspace_id, path FROM snap UNION SELECT workspace_id, path FROM known) a WHERE a.workspace_id = c.workspace_id AND a.path = c.file_path)"


# Observability


@query
def provider_stats(spark, d):
    """Statistics per provider and model."""
    return observe.provider_stats(table(spark, d, "call_records"), ["provider", "model"]).drop("last_call", "last_error")


SQL["provider_stats"] = "SELECT provider, model, count(*) AS calls, count(*) FILTER (success) AS successes, round(count(*) FILTER (success)::DOUBLE / count(*), 6) AS success_rate, round(avg(duration_ms) FILTER (NOT isnan(duration_ms)), 3) AS avg_latency, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(cost_usd), 4) AS cost FROM call_records GROUP BY ALL"


@query
def provider_health(spark, d):
    """Failures since the last success, and the unhealthy providers last."""
    c = table(spark, d, "call_records")
    s = observe.failure_streak(c, ["provider"], ["called_at", "call_id", "received_at"], "success")
    return s.withColumn("position", F.expr("row_number() over (order by streak >= 2, provider nulls last)").cast("long"))  # one row per provider


SQL["provider_health"] = """WITH l AS (SELECT provider, max((called_at, call_id, received_at)) FILTER (success) AS t FROM call_records GROUP BY 1),
s AS (SELECT c.provider, count(*) FILTER (NOT coalesce(success, false) AND (l.t IS NULL OR (called_at, call_id, received_at) > l.t)) AS streak FROM call_records c JOIN l ON l.provider IS NOT DISTINCT FROM c.provider GROUP BY 1)
SELECT provider, streak, row_number() OVER (ORDER BY streak >= 2, provider NULLS LAST) AS position FROM s"""


@query
def counter_labels(spark, d):
    """Calls counted per label set."""
    return observe.counters(table(spark, d, "call_records"), F.lit("calls_total"), {"provider": F.col("provider"), "ok": F.col("success"), "strategy": F.col("strategy")})


_COUNTERS = """SELECT 'calls_total' AS name, 'ok="' || coalesce(CAST(success AS VARCHAR), '') || '",provider="' || coalesce(provider, '') || '",strategy="' || coalesce(strategy, '') || '"' AS labels, count(*)::DOUBLE AS value FROM call_records GROUP BY ALL"""
SQL["counter_labels"] = _COUNTERS


@query
def prometheus(spark, d):
    """SK6: counters as lines of text."""
    return observe.prometheus(counter_labels(spark, d))


SQL["prometheus"] = f"SELECT name || '{{' || labels || '}} ' || CAST(value AS VARCHAR) AS line FROM ({_COUNTERS})"


@query
def histogram_buckets(spark, d):
    """A10: durations in fixed buckets, counted once."""
    return observe.histogram(table(spark, d, "call_records"), ["provider"], "duration_ms")


SQL["histogram_buckets"] = "WITH b AS (SELECT unnest([1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 'Infinity'::DOUBLE]) AS le), v AS (SELECT provider, duration_ms AS x FROM call_records WHERE duration_ms IS NOT NULL AND NOT isnan(duration_ms)) SELECT provider, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le AS BIGINT) AS VARCHAR) END AS le, count(*) FILTER (x <= le) AS n FROM v, b GROUP BY provider, b.le"


@query
def log_tail(spark, d):
    """The newest errors of a component."""
    e = table(spark, d, "events").select(F.col("event_id").alias("log_id"), "ts", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("event_type").alias("component"), F.col("props").alias("message"))
    return observe.logs(e, level="error", component="Error", since="2024-01-02", limit=200).select("log_id", "level", "component", "message")


SQL["log_tail"] = "SELECT event_id AS log_id, 'ERROR' AS level, event_type AS component, props AS message FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-02' ORDER BY ts DESC, event_id DESC LIMIT 200"


@query
def rate_limit(spark, d):
    """A token bucket per user over the event stream."""
    r = observe.rate_limited(table(spark, d, "events"), "user_id", "ts", "event_id", rate=0.02, burst=3)
    return r.groupBy("user_id", "allowed").agg(F.count("*").alias("n"))


SQL["rate_limit"] = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s(user_id, n, had, last) AS (SELECT user_id, n, 3.0::DOUBLE, t FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, least(3.0::DOUBLE, CASE WHEN s.had >= 1 THEN s.had - 1 ELSE s.had END + greatest(0.0::DOUBLE, e.t - s.last) * 0.02::DOUBLE / 60.0::DOUBLE), greatest(e.t, s.last) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1),
r AS (SELECT user_id, had >= 1 AS allowed FROM s UNION ALL SELECT user_id, false FROM events WHERE user_id IS NULL OR ts IS NULL)
SELECT user_id, allowed, count(*) AS n FROM r GROUP BY ALL"""


@query
def idempotency(spark, d):
    """Redelivered calls as replays and conflicts within a day."""
    c = table(spark, d, "call_records").withColumn("payload", T.payload_hash("provider", "model", "total_tokens")).withColumn("at", F.col("received_at")).withColumn("row", F.concat_ws("/", "call_id", "received_at"))
    return observe.idempotent(c, "call_id", "payload", "at", "row").groupBy("outcome").agg(F.count("*").alias("n"))


SQL["idempotency"] = """WITH RECURSIVE e AS (SELECT call_id, (provider, model, total_tokens) AS p, epoch_us(received_at) / 1e6 AS t, row_number() OVER (PARTITION BY call_id ORDER BY received_at, call_id || '/' || received_at) AS n FROM call_records WHERE call_id IS NOT NULL AND received_at IS NOT NULL),
s(call_id, n, p, t, outcome) AS (SELECT call_id, n, p, t, 'new' FROM e WHERE n = 1
UNION ALL SELECT e.call_id, e.n, CASE WHEN e.t - s.t > 86400 THEN e.p ELSE s.p END, CASE WHEN e.t - s.t > 86400 THEN e.t ELSE s.t END, CASE WHEN e.t - s.t > 86400 THEN 'new' WHEN e.p IS NOT DISTINCT FROM s.p THEN 'replay' ELSE 'conflict' END FROM s JOIN e ON e.call_id = s.call_id AND e.n = s.n + 1)
SELECT outcome, count(*) AS n FROM (SELECT outcome FROM s UNION ALL SELECT 'new' FROM call_records WHERE call_id IS NULL OR received_at IS NULL) GROUP BY 1"""


@query
def lint_severity(spark, d):
    """Severities of codes."""
    codes = table(spark, d, "call_records").select(F.concat(F.element_at(F.array(F.lit("E9"), F.lit("E5"), F.lit("F4"), F.lit("W2"), F.lit("N8")), (F.col("call_id") % 5 + 1).cast("int")), F.lit("01")).alias("code"))
    return codes.groupBy(observe.severity("code").alias("severity")).agg(F.count("*").alias("n"))


SQL["lint_severity"] = "WITH c AS (SELECT (['E9', 'E5', 'F4', 'W2', 'N8'])[call_id % 5 + 1] AS c FROM call_records) SELECT CASE WHEN c LIKE 'E9%' OR c LIKE 'F%' THEN 'error' WHEN c LIKE 'E%' OR c LIKE 'W%' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM c GROUP BY 1"


# Projects


def _project(spark, d):
    return snapshot(spark, d).select(*KEYS, F.octet_length(F.coalesce("content", F.lit(""))).cast("long").alias("size"))


@query
def dir_rollup(spark, d):
    """Totals along the tree, cut at depth three."""
    return project.rollup(_project(spark, d), ["workspace_id"], "path", "size", max_depth=3)


SQL["dir_rollup"] = f"""WITH {SNAP}, p AS (SELECT workspace_id, string_split(path, '/') AS p, strlen(coalesce(content, '')) AS size FROM snap), x AS (SELECT workspace_id, size, p, unnest(range(len(p))) AS k FROM p),
g AS (SELECT workspace_id, array_to_string(p[1:k], '/') AS dir, k AS depth, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM x GROUP BY 1, 2, 3)
SELECT workspace_id, coalesce(dir, '') AS dir, depth, CASE WHEN depth = 3 THEN 0 ELSE files END AS files, CASE WHEN depth = 3 THEN 0 ELSE bytes END AS bytes, depth = 3 AS truncated FROM g WHERE depth <= 3"""


@query
def dir_tree(spark, d):
    """SC12: entries down to depth two."""
    return project.tree(_project(spark, d), ["workspace_id"], "path", 2)


SQL["dir_tree"] = f"""WITH {SNAP}, p AS (SELECT workspace_id, path, string_split(path, '/') AS p FROM snap), x AS (SELECT workspace_id, p, unnest(range(1, len(p))) AS k FROM p),
e AS (SELECT workspace_id, array_to_string(p[1:k], '/') AS entry, 'dir' AS kind, k AS depth FROM x UNION SELECT workspace_id, path, 'file', len(p) FROM p) SELECT * FROM e WHERE depth <= 2 AND NOT regexp_matches(entry, '(^|/)\\.[^/]')"""


@query
def top_extensions(spark, d):
    """Commonest extensions per workspace."""
    return project.extensions(_project(spark, d), ["workspace_id"], "path", "size", 3)


SQL["top_extensions"] = f"WITH {SNAP}, g AS (SELECT workspace_id, regexp_extract(lower(string_split(path, '/')[-1]), '^.+\\.([^.]+)$', 1) AS extension, count(*) AS files, CAST(sum(strlen(coalesce(content, ''))) AS BIGINT) AS bytes FROM snap GROUP BY 1, 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY files DESC, extension) <= 3"


# Transformations and functions


@query
def token_estimate(spark, d):
    """A quarter of the characters."""
    return table(spark, d, "documents").select("doc_id", T.token_estimate("text").alias("tokens"))


SQL["token_estimate"] = "SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM documents"


@query
def chunk_fixed(spark, d):
    """Pieces of 500 characters."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(T.fixed_pieces("text", 500)).alias("n", "piece"))
    return x.select("doc_id", F.col("n").cast("long").alias("n"), F.md5("piece").alias("md5"))


SQL["chunk_fixed"] = "WITH p AS (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500.0) AS BIGINT))) AS n FROM documents) SELECT doc_id, n, md5(substr(text, n * 500 + 1, 500)) AS md5 FROM p"


@query
def head_tail(spark, d):
    """Heads and tails of long texts."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.head_and_tail("text", 400)).alias("md5"))


SQL["head_tail"] = "SELECT doc_id, md5(CASE WHEN length(text) > 400 THEN substr(text, 1, 200) || chr(10) || '# ... (cut) ...' || chr(10) || right(text, 200) ELSE text END) AS md5 FROM documents"


@query
def snippets(spark, d):
    """The surroundings of a word, and a text's query words."""
    x = table(spark, d, "documents").withColumn("at", F.instr(F.lower("text"), "cursor") - 1).where("at >= 0")
    return x.select("doc_id", T.snippet("text", F.col("at")).alias("snippet"), F.size(T.query_words("text")).cast("long").alias("words"))


SQL["snippets"] = r"""WITH x AS (SELECT doc_id, text, instr(lower(text), 'cursor') - 1 AS at0 FROM documents WHERE instr(lower(text), 'cursor') > 0), s AS (SELECT *, greatest(at0 - 40, 0) AS a, least(length(text), at0 + 80) AS b FROM x)
SELECT doc_id, CASE WHEN a > 0 OR b < length(text) THEN '…' || replace(substr(text, a + 1, b - a), chr(10), ' ') || '…' ELSE replace(substr(text, a + 1, b - a), chr(10), ' ') END AS snippet, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 2)) AS words FROM s"""


@query
def vector_roundtrip(spark, d):
    """Unit vectors have length one."""
    x = table(spark, d, "chunks").select("faiss_id", T.unit_vector("embedding").alias("u")).where("u is not null")
    return x.select("faiss_id", F.round(T.dot(F.col("u"), F.col("u")), 9).alias("norm"))


SQL["vector_roundtrip"] = "SELECT faiss_id, 1.0::DOUBLE AS norm FROM chunks WHERE list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0"


@query
def mode_detect(spark, d):
    """Modes, intents and first providers of all lines of every document, as if each were a query."""
    q = doc_lines(spark, d).withColumn("mode", planner.mode_column(F.col("line")))
    q = q.withColumn("intent", planner.intent_column(F.col("line"), F.col("mode"))).withColumn("plan", planner.plan_column(F.col("intent")))
    return q.groupBy("doc_id", "mode", "intent", F.col("plan.providers")[0].alias("provider")).agg(F.count("*").alias("n"))


def _mode_sql():
    esc = lambda p: p.replace("'", "''")
    words = ", ".join(f"'{w}'" for w in planner.STOPWORDS + planner.LITERALS)
    path = lambda c: f"regexp_matches({c}, '{planner.PATH}') AND regexp_matches({c}, '[/\\\\]')"
    return rf"""WITH {DOC_LINES}, q AS (SELECT doc_id, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS q FROM lines),
b AS (SELECT *, CASE WHEN length(q) >= 2 AND regexp_matches(q, '(?s)^(".*"|''.*'')$') THEN regexp_replace(substr(q, 2, length(q) - 2), '^\s+|\s+$', '', 'g') ELSE q END AS b FROM q),
m AS (SELECT doc_id, line, CASE WHEN regexp_matches(q, '{esc(planner.QUOTED)}') THEN 'text' WHEN b = '' THEN 'semantic'
WHEN regexp_matches(b, '{planner.DECLARATION}') OR (instr(b, ' ') = 0 AND (length(b) <= 2 OR lower(b) IN ({words}) OR regexp_matches(b, '[-:/]'))) OR regexp_matches(b, '{planner.CONSTANT}') OR regexp_matches(b, '{esc(planner.SIGNS)}') OR ({path('b')}) THEN 'text'
WHEN regexp_matches(b, '{planner.IDENTIFIER}') AND length(b) <= 60 THEN 'symbol' WHEN len(regexp_split_to_array(b, '\s+')) <= 3 AND length(b) <= 40 THEN 'hybrid' ELSE 'semantic' END AS mode FROM b),
i AS (SELECT *, CASE WHEN mode = 'semantic' AND {path('line')} THEN 'file_path' WHEN mode = 'text' THEN 'exact_text' WHEN mode = 'symbol' THEN 'exact_symbol' ELSE mode END AS intent FROM m)
SELECT doc_id, mode, intent, CASE intent WHEN 'semantic' THEN 'semantic_vector' WHEN 'exact_text' THEN 'exact_line_fts' WHEN 'file_path' THEN 'exact_line_fts' ELSE 'local_exact_index' END AS provider, count(*) AS n FROM i GROUP BY ALL"""


SQL["mode_detect"] = _mode_sql()


@query
def comment_strip(spark, d):
    """Files without their comments."""
    x = snapshot(spark, d).select(*KEYS, "content", T.language("path").alias("language"))
    return x.select(*KEYS, F.md5(transform.stripped(F.col("content"), F.col("language"))).alias("md5"))


@query
def body_fold(spark, d):
    """X11: files with folded bodies."""
    x = snapshot(spark, d).select(*KEYS, "content", T.language("path").alias("language"))
    return x.select(*KEYS, F.md5(transform.folded(F.col("content"), F.col("language"))).alias("md5"))


@query
def budget_prune(spark, d):
    """Files of every workspace within 20000 tokens, newest first."""
    x = snapshot(spark, d).select(*KEYS, "content", "revision", T.language("path").alias("language"))
    return transform.pruned(x, "workspace_id", "path", "revision", "content", "language", 20_000).withColumn("md5", F.md5("content")).drop("content")


@query
def symbol_chunking(spark, d):
    """Chunks of every file of the snapshot."""
    c = transform.symbol_chunks(snapshot(spark, d).select(*KEYS, "content"), KEYS, "path", "content")
    return c.select(*KEYS, "chunk_type", "name", "start", "stop", F.md5("content").alias("md5"), "chunk_id")


SQL["symbol_chunking"] = f"""WITH {SYMBOLS}, f AS (SELECT workspace_id, path, content, string_split(content, chr(10)) AS ls FROM snap WHERE content IS NOT NULL),
s AS (SELECT s.*, coalesce(lead(line_start) OVER (PARTITION BY s.workspace_id, s.path ORDER BY line_start) - 1, len(ls)) AS stop, ls FROM symbols s JOIN f ON f.workspace_id = s.workspace_id AND f.path = s.path),
n AS (SELECT workspace_id, path, array_to_string((list(name ORDER BY line_start))[1:30], ', ') AS names FROM symbols GROUP BY ALL),
c AS (SELECT workspace_id, path, CASE WHEN kind IN ('class', 'trait', 'object', 'interface', 'enum', 'struct', 'union', 'impl', 'record', 'mod', 'namespace') THEN 'class' ELSE 'function' END AS chunk_type, name, line_start AS start, stop, array_to_string(ls[line_start:stop], chr(10)) AS content FROM s
UNION ALL SELECT f.workspace_id, f.path, CASE WHEN names IS NULL THEN 'file' ELSE 'file_overview' END, '', 1, len(ls), CASE WHEN names IS NULL THEN substr(content, 1, 4000) ELSE '# ' || f.path || chr(10) || array_to_string(ls[1:20], chr(10)) || chr(10) || '# ' || names END FROM f LEFT JOIN n ON n.workspace_id = f.workspace_id AND n.path = f.path)
SELECT workspace_id, path, chunk_type, name, start, stop, md5(content) AS md5, path || ':' || chunk_type || ':' || name || ':' || start || ':' || (row_number() OVER (PARTITION BY workspace_id, path ORDER BY start, chunk_type DESC, name) - 1) AS chunk_id FROM c"""


@query
def text_references(spark, d):
    """Of every symbol of the chunks, how many lines outside tests name it, and in how many files."""
    named = table(spark, d, "chunks").select(F.get_json_object("metadata", "$.symbol_name").alias("name")).where("name rlike '^[A-Za-z_][A-Za-z0-9_]*$'").distinct()
    x = file_lines(spark, d).where(~T.is_test_like("path"))
    words = F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0))
    per_file = x.select(*KEYS, F.explode(words).alias("name")).groupBy(*KEYS, "name").agg(F.count("*").alias("lines"))
    found = per_file.groupBy("name").agg(F.sum("lines").alias("lines"), F.count("*").alias("files"))
    return named.join(found, "name", "left").na.fill(0, ["lines", "files"])


SQL["text_references"] = rf"""WITH {LINES}, n AS (SELECT DISTINCT json_extract_string(metadata, '$.symbol_name') AS name FROM chunks WHERE regexp_matches(json_extract_string(metadata, '$.symbol_name'), '^[A-Za-z_][A-Za-z0-9_]*$')),
l AS (SELECT workspace_id, path, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*'))) AS name FROM lines WHERE NOT ({_TEST_LIKE})),
f AS (SELECT name, count(*) AS lines, count(DISTINCT workspace_id || chr(0) || path) AS files FROM l GROUP BY name)
SELECT n.name, coalesce(lines, 0) AS lines, coalesce(files, 0) AS files FROM n LEFT JOIN f ON f.name = n.name"""


@query
def sampled_digests(spark, d):
    """Sampled digests of every pushed content."""
    return table(spark, d, "sync_files").select("sync_id", T.sampled_digest("content", 4096, 512).alias("digest"))


SQL["sampled_digests"] = "SELECT sync_id, CASE WHEN strlen(content) > 4608 THEN sha256(unhex(substr(hex(encode(content)), 1, 8192)) || unhex(right(hex(encode(content)), 1024))) ELSE sha256(content) END AS digest FROM sync_files"


@query
def event_debounce(spark, d):
    """Bursts of pushes to a file, closed by a pause of a minute, with the last operation of each."""
    return ingest.debounced(_timed(spark, d), KEYS, "at", "seq", "op", 60_000)


SQL["event_debounce"] = """WITH l AS (SELECT workspace_id, path, epoch_ms(received_at) AS t, sync_id AS seq, CASE WHEN content = '' THEN 'delete' ELSE 'upsert' END AS op FROM sync_files),
p AS (SELECT *, lag(t) OVER (PARTITION BY workspace_id, path ORDER BY t, seq) AS before FROM l),
b AS (SELECT *, sum(CASE WHEN t - before <= 60000 THEN 0 ELSE 1 END) OVER (PARTITION BY workspace_id, path ORDER BY t, seq) AS burst FROM p)
SELECT workspace_id, path, CAST(burst - 1 AS BIGINT) AS burst, min(t) AS begun, max(t) AS ended, count(*) AS events, arg_max(op, (t, seq)) AS op FROM b GROUP BY ALL"""


@query
def queue_state(spark, d):
    """Pending, accepted and failed files after acknowledgements; every third revision is taken to fail once."""
    log = _log(spark, d).withColumn("event", F.when(F.col("revision") % 3 == 0, "fail").otherwise("ack"))
    return ingest.queue_state(log.select(*KEYS, "seq", F.lit("add").alias("event"), "revision").unionByName(log.where("seq % 2 = 0").select(*KEYS, (F.col("seq") + 1_000_000_000).alias("seq"), "event", "revision")), KEYS).na.fill(-1, ["accepted_revision"])


SQL["queue_state"] = """WITH l AS (SELECT workspace_id, path, sync_id AS seq, 'add' AS event, revision FROM sync_files UNION ALL SELECT workspace_id, path, sync_id + 1000000000, CASE WHEN revision % 3 = 0 THEN 'fail' ELSE 'ack' END, revision FROM sync_files WHERE sync_id % 2 = 0),
g AS (SELECT workspace_id, path, max(revision) FILTER (event = 'add') AS added, max(revision) FILTER (event = 'ack') AS accepted, count(*) FILTER (event = 'fail') AS failures FROM l GROUP BY ALL)
SELECT workspace_id, path, added AS revision, coalesce(accepted, -1) AS accepted_revision, failures, CASE WHEN accepted >= added THEN 'accepted' WHEN failures > 0 THEN 'retry' ELSE 'pending' END AS state FROM g"""


@query
def log_buffer(spark, d):
    """Of each provider's calls the newest 500, and how many older ones fell out."""
    c = table(spark, d, "call_records").select("provider", "call_id", "called_at", "received_at")
    return observe.newest(c, ["provider"], ["called_at", "call_id", "received_at"], 500).groupBy("provider").agg(F.count("*").alias("kept"), F.max("dropped").alias("dropped"), F.min("call_id").alias("least_id"))


SQL["log_buffer"] = """WITH r AS (SELECT provider, call_id, row_number() OVER (PARTITION BY provider ORDER BY called_at DESC NULLS LAST, call_id DESC NULLS LAST, received_at DESC NULLS LAST) AS r, count(*) OVER (PARTITION BY provider) AS n FROM call_records)
SELECT provider, count(*) AS kept, max(greatest(n - 500, 0)) AS dropped, min(call_id) AS least_id FROM r WHERE r <= 500 GROUP BY provider"""


@query
def provider_chain(spark, d):
    """R2: per workspace the first source of answers on a word that has any: symbols of chunks, then lines of files, then
    documents."""
    c = table(spark, d, "chunks").where(T.contains_ci(F.get_json_object("metadata", "$.symbol_name"), "cursor")).select("workspace_id", F.col("faiss_id").alias("hit"))
    f = snapshot(spark, d).where(T.contains_ci("content", "cursor")).select("workspace_id", F.col("sync_id").alias("hit"))
    t = table(spark, d, "documents").where(T.contains_ci("text", "cursor")).select("workspace_id", F.col("doc_id").alias("hit"))
    return observe.first_provider({"symbols": c, "text": f, "documents": t}, ["workspace_id"])


SQL["provider_chain"] = f"""WITH {SNAP}, a AS (SELECT workspace_id, 0 AS p, 'symbols' AS provider FROM chunks WHERE instr(lower(json_extract_string(metadata, '$.symbol_name')), 'cursor') > 0
UNION ALL SELECT workspace_id, 1, 'text' FROM snap WHERE instr(lower(content), 'cursor') > 0 UNION ALL SELECT workspace_id, 2, 'documents' FROM documents WHERE instr(lower(text), 'cursor') > 0)
SELECT workspace_id, provider, count(*) AS hits FROM (SELECT * FROM a QUALIFY p = min(p) OVER (PARTITION BY workspace_id)) GROUP BY workspace_id, provider"""
