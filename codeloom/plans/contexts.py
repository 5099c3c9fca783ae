"""Queries that put several operators together."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import compose, graph, memory, symbols
from codeloom.plans.base import KEYS, SQL, file_lines, query
from codeloom.plans.retrieval import SYMBOLS
from codeloom.session import table


@query
def context_compose(spark, d):
    """Symbols, hubs, memories and notes on a word under one token budget."""
    syms = symbols.search(symbols.symbols(file_lines(spark, d), KEYS), "cursor", "path", limit=5)
    e = graph.edges(table(spark, d, "inheritance_edges"), "workspace_id", "child", "parent")
    hubs = e.groupBy("scope", "dst").agg(F.count("*").alias("n"))
    mem = table(spark, d, "memories")
    ranked = memory.rank(memory.select(mem), "cursor index", limit=5).join(mem.select("id", "content"), "id")
    docs = table(spark, d, "documents").where(T.contains_ci("text", "cursor"))
    out = compose.context(
        {
            "symbols": compose.numbered(syms, F.concat_ws(" ", "path", "signature"), [F.desc("score"), F.lower("name"), "path", "line_start"], 5),
            "hubs": compose.numbered(hubs, F.concat_ws(" ", "scope", "dst", F.col("n").cast("string")), [F.desc("n"), "scope", "dst"], 5),
            "memories": compose.numbered(ranked, F.col("content"), [F.desc("score"), "id"], 5),
            "notes": compose.numbered(docs, F.col("text"), ["n_chars", "doc_id"], 10),
        },
        1024,
    )
    return out.select("section", "rank", "tokens", "used")


_WORDS = "['cursor', 'index']"
SQL["context_compose"] = f"""WITH {SYMBOLS}, sy0 AS (SELECT *, CASE WHEN lower(name) = 'cursor' THEN 1.0 WHEN starts_with(lower(name), 'cursor') THEN 0.9 WHEN instr(lower(name), 'cursor') > 0 THEN 0.7 END AS score FROM symbols),
sy AS (SELECT 0 AS o, 'symbols' AS section, row_number() OVER (ORDER BY score DESC, name = 'cursor' DESC, kind = 'class' DESC, lower(name), path, line_start) AS first, row_number() OVER (ORDER BY score DESC, lower(name), path, line_start) AS rank, path || ' ' || signature AS text FROM sy0 WHERE score >= 0.5 AND ((SELECT max(score) FROM sy0) < 1.0 OR score = 1.0)),
h AS (SELECT scope, dst, count(*) AS n FROM (SELECT DISTINCT workspace_id AS scope, child AS src, parent AS dst FROM inheritance_edges WHERE workspace_id IS NOT NULL AND child IS NOT NULL AND parent IS NOT NULL) GROUP BY ALL),
hu AS (SELECT 1 AS o, 'hubs' AS section, row_number() OVER (ORDER BY n DESC, scope, dst) AS rank, scope || ' ' || dst || ' ' || n AS text FROM h QUALIFY rank <= 5),
m0 AS (SELECT id, content, lower(coalesce(content, '')) AS c, lower(coalesce(category, '')) AS cat, lower(coalesce(subcategory, '')) AS sub,
list_transform(coalesce(CAST(from_json(CASE WHEN json_valid(tags_json) THEN tags_json END, '["VARCHAR"]') AS VARCHAR[]), []), lambda x: lower(coalesce(x, ''))) AS t,
list_transform(coalesce(CAST(from_json(CASE WHEN json_valid(related_files_json) THEN related_files_json END, '["VARCHAR"]') AS VARCHAR[]), []), lambda x: lower(x)) AS f FROM memories WHERE status = 'active'),
m1 AS (SELECT id, content, round(least(1.0, (len(list_filter({_WORDS}, lambda x: instr(c, x) > 0)) / 2.0::DOUBLE + least(1.0, len(list_intersect({_WORDS}, t)) / 2.0::DOUBLE) + CASE WHEN len(list_filter({_WORDS}, lambda x: instr(cat, x) > 0)) > 0 THEN 0.4 ELSE 0 END + CASE WHEN len(list_filter({_WORDS}, lambda x: instr(sub, x) > 0)) > 0 THEN 0.3 ELSE 0 END
+ CASE WHEN len(list_filter(f, lambda y: len(list_filter({_WORDS}, lambda x: instr(y, x) > 0)) > 0)) > 0 THEN 0.5 ELSE 0 END) / 1.5)::DOUBLE, 4) AS score FROM m0),
me AS (SELECT 2 AS o, 'memories' AS section, row_number() OVER (ORDER BY score DESC, id) AS rank, content AS text FROM m1 WHERE score >= 0.3 QUALIFY rank <= 5),
no AS (SELECT 3 AS o, 'notes' AS section, row_number() OVER (ORDER BY n_chars, doc_id) AS rank, text FROM documents WHERE instr(lower(text), 'cursor') > 0 QUALIFY rank <= 10),
x AS (SELECT o, section, row_number() OVER (ORDER BY rank) AS rank, text FROM sy WHERE first <= 5 UNION ALL SELECT * FROM hu UNION ALL SELECT * FROM me UNION ALL SELECT * FROM no),
y AS (SELECT *, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM x), z AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY o, rank) AS BIGINT) AS used FROM y)
SELECT section, rank, tokens, used FROM z WHERE used <= 1024"""


@query
def version_diffs(spark, d):
    """Added and removed lines between each version of a file and the one before."""
    f = table(spark, d, "sync_files").select("sync_id", *KEYS, "revision", "content")
    w = "over (partition by workspace_id, path order by revision, sync_id)"
    x = f.withColumn("before", F.expr(f"lag(content) {w}")).withColumn("n", F.expr(f"row_number() {w}")).where("n > 1")
    return x.select("sync_id", compose.unified_diff(F.col("before"), F.col("content"), F.col("path")).alias("r")).select("sync_id", "r.added", "r.removed")


@query
def hashed_vectors(spark, d):
    """memories' contents as hashed vectors, by length."""
    x = table(spark, d, "memories").select("id", compose.hashed_embedding("content").alias("v"))
    return x.select("id", F.coalesce(F.size("v"), F.lit(-1)).cast("long").alias("dim"), F.round(T.dot(F.col("v"), F.col("v")), 4).alias("norm"))


SQL["hashed_vectors"] = r"SELECT id, CASE WHEN len(w) > 0 THEN 64 ELSE -1 END AS dim, CASE WHEN len(w) > 0 THEN 1.0::DOUBLE END AS norm FROM (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2) AS w FROM memories)"


@query
def recent_clients(spark, d):
    """The workspaces a client may still push to, by a lookup with an end of validity."""
    f = table(spark, d, "sync_files").where("client_id is not null")
    tokens = f.groupBy("client_id").agg(F.max("received_at").alias("expires_at"), F.min("workspace_id").alias("label")).select(F.col("client_id").alias("username"), F.sha2("client_id", 256).alias("token_hash"), "label", "expires_at")
    users = f.groupBy(F.col("client_id").alias("username")).agg(F.when(F.count("*") > 20, "editor").otherwise("viewer").alias("role"))
    first = f.select(F.min("client_id").alias("c")).first()["c"]
    import hashlib

    return compose.authenticated(tokens, users, hashlib.sha256((first or "").encode()).hexdigest(), "2025-06-01")


SQL["recent_clients"] = "SELECT client_id AS username, CASE WHEN count(*) > 20 THEN 'editor' ELSE 'viewer' END AS role, min(workspace_id) AS label FROM sync_files WHERE client_id = (SELECT min(client_id) FROM sync_files) GROUP BY 1 HAVING max(received_at) > TIMESTAMPTZ '2025-06-01 00:00:00+00'"
