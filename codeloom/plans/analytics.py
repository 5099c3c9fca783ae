"""Queries of graph, memory and history analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import graph, history, memory
from codeloom.plans.base import SNAP, SQL, query, snapshot
from codeloom.session import table

# Graph: a class depends on its parents


def _edges(spark, d):
    return graph.edges(table(spark, d, "inheritance_edges"), "workspace_id", "child", "parent")


def _files(spark, d):
    return table(spark, d, "inheritance_edges").select(F.col("workspace_id").alias("scope"), F.col("child").alias("src"), F.col("parent").alias("dst"), "path").distinct()


def _hubs(e, n=3):
    """The classes with the most subclasses."""
    return e.groupBy("scope", F.col("dst").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "scope", "node").limit(n).select("scope", "node")


def _deep(e, n=3):
    """The last classes by name that have a parent."""
    return e.select("scope", F.col("src").alias("node")).distinct().orderBy(F.desc("node"), "scope").limit(n)


def _every(e):
    """Every class."""
    return e.select("scope", F.col("src").alias("node")).unionByName(e.select("scope", F.col("dst").alias("node"))).distinct()


_E = """e AS (SELECT DISTINCT workspace_id AS scope, child AS src, parent AS dst FROM inheritance_edges WHERE workspace_id IS NOT NULL AND child IS NOT NULL AND parent IS NOT NULL),
hubs AS (SELECT scope, dst AS node FROM e GROUP BY ALL ORDER BY count(*) DESC, scope, node LIMIT 3),
deep AS (SELECT DISTINCT scope, src AS node FROM e ORDER BY node DESC, scope LIMIT 3),
files AS (SELECT DISTINCT workspace_id AS scope, child AS src, parent AS dst, path FROM inheritance_edges)"""


def _bfs(name, starts, a, b, depth):
    return f"""{name}0 AS (SELECT scope, node AS start, node, 0 AS level FROM {starts}
UNION SELECT r.scope, r.start, e.{b}, r.level + 1 FROM {name}0 r JOIN e ON e.scope = r.scope AND e.{a} = r.node WHERE r.level < {depth}),
{name} AS (SELECT scope, start, node, min(level) AS level FROM {name}0 WHERE node <> start GROUP BY ALL)"""


@query
def graph_neighbours(spark, d):
    """Direct callers and callees of the hubs."""
    e = _edges(spark, d)
    return graph.neighbours(e, _hubs(e))


SQL["graph_neighbours"] = f"WITH {_E} SELECT h.scope, h.node, 'callee' AS direction, dst AS other FROM hubs h JOIN e ON e.scope = h.scope AND e.src = h.node UNION SELECT h.scope, h.node, 'caller', src FROM hubs h JOIN e ON e.scope = h.scope AND e.dst = h.node"


@query
def graph_bfs(spark, d):
    """Three hops back from the hubs."""
    e = _edges(spark, d)
    return graph.reach(e, _hubs(e), 3, forward=False)


SQL["graph_bfs"] = f"WITH RECURSIVE {_E}, {_bfs('r', 'hubs', 'dst', 'src', 3)} SELECT scope, start, node, level FROM r"


@query
def inheritance_closure(spark, d):
    """Ancestors within 16 hops; a loop may lead back to the start."""
    e = _edges(spark, d)
    return graph.reach(e, _deep(e), 16, keep_start=True)


SQL["inheritance_closure"] = f"""WITH RECURSIVE {_E}, r0 AS (SELECT scope, node AS start, node, 0 AS level FROM deep UNION SELECT r.scope, r.start, e.dst, r.level + 1 FROM r0 r JOIN e ON e.scope = r.scope AND e.src = r.node WHERE r.level < 16)
SELECT scope, start, node, min(level) AS level FROM r0 WHERE level > 0 GROUP BY ALL"""


@query
def graph_roots(spark, d):
    """Classes without subclasses that have a parent."""
    return graph.roots(_edges(spark, d))


SQL["graph_roots"] = f"WITH {_E} SELECT DISTINCT scope, src AS node FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.scope = e.scope AND f.dst = e.src)"


@query
def graph_dead(spark, d):
    """Roots that are neither entry points nor tests."""
    return graph.dead(_edges(spark, d))


SQL["graph_dead"] = f"WITH {_E} SELECT DISTINCT scope, src AS node FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.scope = e.scope AND f.dst = e.src) AND NOT regexp_matches(lower(src), 'main|app|create_app|__init__|__main__|setup|teardown|conftest') AND NOT starts_with(lower(src), 'test_')"


_IMPACT = f"""{_E}, {_bfs('f', 'hubs', 'src', 'dst', 2)}, {_bfs('b', 'hubs', 'dst', 'src', 2)},
own AS (SELECT scope, node AS start, node FROM hubs),
every AS (SELECT scope, start, node FROM f UNION SELECT scope, start, node FROM b UNION SELECT * FROM own),
touched AS (SELECT y.scope, y.start, x.path FROM every y JOIN files x ON x.scope = y.scope AND x.src = y.node UNION SELECT y.scope, y.start, x.path FROM every y JOIN files x ON x.scope = y.scope AND x.dst = y.node),
imp AS (SELECT o.scope, o.start, (SELECT count(*) FROM f WHERE f.scope = o.scope AND f.start = o.start) AS affected, (SELECT count(*) FROM b WHERE b.scope = o.scope AND b.start = o.start) AS dependents,
(SELECT count(DISTINCT node) FROM (SELECT * FROM f UNION ALL SELECT * FROM b) z WHERE z.scope = o.scope AND z.start = o.start) AS blast_radius, (SELECT count(*) FROM touched t WHERE t.scope = o.scope AND t.start = o.start) AS files FROM own o)"""


@query
def graph_impact(spark, d):
    """Affected, dependents, files and blast radius of the hubs."""
    e = _edges(spark, d)
    return graph.impact(e, _files(spark, d), _hubs(e))


SQL["graph_impact"] = f"WITH RECURSIVE {_IMPACT} SELECT * FROM imp"


_TESTS = _bfs("c", "hubs", "dst", "src", 3) + """, near AS (SELECT scope, start, node FROM c UNION SELECT scope, node, node FROM hubs),
tf AS (SELECT * FROM files WHERE regexp_matches('/' || lower(path) || '/', '/tests?/') OR regexp_matches(lower(string_split(path, '/')[-1]), '^test_|(_tests?\\.py|tests?\\.java|tests?\\.scala|spec\\.scala)$')),
tests AS (SELECT n.scope, n.start, path FROM near n JOIN tf ON tf.scope = n.scope AND tf.src = n.node UNION SELECT n.scope, n.start, path FROM near n JOIN tf ON tf.scope = n.scope AND tf.dst = n.node)"""


@query
def graph_tests(spark, d):
    """Test files near the hubs."""
    e = _edges(spark, d)
    return graph.related_tests(e, _files(spark, d), _hubs(e))


SQL["graph_tests"] = f"WITH RECURSIVE {_E}, {_TESTS} SELECT scope, start, path FROM tests"


@query
def graph_tests_by_name(spark, d):
    """Test files of the snapshot named after a class."""
    return graph.tests_by_name(_every(_edges(spark, d)), snapshot(spark, d), "workspace_id", "path")


SQL["graph_tests_by_name"] = rf"""WITH {SNAP}, {_E}, n AS (SELECT scope, src AS node FROM e UNION SELECT scope, dst FROM e),
t AS (SELECT workspace_id AS scope, path, regexp_replace(lower(replace(replace(regexp_replace(string_split(path, '/')[-1], '\.[^.]*(\.[^.]*)?$', ''), '_', ''), '-', '')), '^tests?|(tests?|spec)$', '', 'g') AS k FROM snap
WHERE regexp_matches('/' || lower(path) || '/', '/tests?/') OR regexp_matches(lower(string_split(path, '/')[-1]), '^test_|(_tests?\.py|tests?\.java|tests?\.scala|spec\.scala)$'))
SELECT DISTINCT n.scope, node, path FROM n JOIN t ON t.scope = n.scope AND t.k = lower(replace(replace(node, '_', ''), '-', '')) AND t.k <> ''"""


@query
def code_graph(spark, d):
    """Edges between directories, three levels deep."""
    return graph.code_graph(table(spark, d, "inheritance_edges"), "workspace_id", "child", "parent", "path")


_DIR = "array_to_string(string_split({0}, '/')[1:least(3, len(string_split({0}, '/')) - 1)], '/')"
SQL["code_graph"] = f"""WITH e AS (SELECT DISTINCT workspace_id AS scope, child AS src, parent AS dst, path FROM inheritance_edges WHERE workspace_id IS NOT NULL AND child IS NOT NULL AND parent IS NOT NULL AND path IS NOT NULL),
h AS (SELECT scope, src AS dst, min(path) AS home FROM e GROUP BY ALL), x AS (SELECT e.scope, {_DIR.format('path')} AS from_dir, CASE WHEN home IS NOT NULL THEN {_DIR.format('home')} END AS to_dir, e.dst FROM e LEFT JOIN h ON h.scope = e.scope AND h.dst = e.dst)
SELECT scope, from_dir, to_dir, count(*) AS edges, count(DISTINCT dst) AS names FROM x GROUP BY ALL"""


@query
def graph_risk(spark, d):
    """Risk of changing each hub."""
    e = _edges(spark, d)
    starts, files = _hubs(e), _files(spark, d)
    found = graph.hops(e, starts, 3)
    return graph.risk(graph.impact(e, files, starts, found=found), graph.related_tests(e, files, starts, found=found))


SQL["graph_risk"] = f"""WITH RECURSIVE {_IMPACT}, {_TESTS}, x AS (SELECT imp.*, (SELECT count(DISTINCT path) FROM tests t WHERE t.scope = imp.scope AND t.start = imp.start) AS n_tests FROM imp),
s AS (SELECT *, CASE WHEN dependents > 10 THEN 3 WHEN dependents > 3 THEN 2 WHEN dependents > 0 THEN 1 ELSE 0 END + CASE WHEN files > 5 THEN 2 WHEN files > 2 THEN 1 ELSE 0 END + CASE WHEN n_tests = 0 THEN 2 WHEN n_tests < 2 THEN 1 ELSE 0 END AS risk_score FROM x)
SELECT *, CASE WHEN risk_score >= 5 THEN 'high' WHEN risk_score >= 3 THEN 'medium' ELSE 'low' END AS risk FROM s"""


@query
def graph_entry_points(spark, d):
    """Classes without subclasses below the hubs, within 20 hops."""
    e = _edges(spark, d)
    return graph.entry_points(e, _hubs(e))


SQL["graph_entry_points"] = f"WITH RECURSIVE {_E}, {_bfs('r', 'hubs', 'dst', 'src', 20)} SELECT scope, start, node FROM r WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.scope = r.scope AND f.dst = r.node) AND EXISTS (SELECT 1 FROM e f WHERE f.scope = r.scope AND f.src = r.node)"


# The same from every class; the SQL above stays that of the reports on three classes

_HUBS = "SELECT scope, dst AS node FROM e GROUP BY ALL ORDER BY count(*) DESC, scope, node LIMIT 3"
_DEEP = "SELECT DISTINCT scope, src AS node FROM e ORDER BY node DESC, scope LIMIT 3"
_EVERY = "SELECT scope, src AS node FROM e UNION SELECT scope, dst FROM e"


@query
def graph_neighbours_all(spark, d):
    """Direct callers and callees of every class."""
    e = _edges(spark, d)
    return graph.neighbours(e, _every(e))


@query
def graph_bfs_all(spark, d):
    """Three hops back from every class."""
    e = _edges(spark, d)
    return graph.reach(e, _every(e), 3, forward=False)


@query
def inheritance_closure_all(spark, d):
    """Ancestors of every class within 16 hops; a loop may lead back to the start."""
    e = _edges(spark, d)
    return graph.reach(e, _every(e), 16, keep_start=True)


@query
def graph_impact_all(spark, d):
    """Affected, dependents, files and blast radius of every class."""
    e = _edges(spark, d)
    return graph.impact(e, _files(spark, d), _every(e))


@query
def graph_tests_all(spark, d):
    """Test files near every class."""
    e = _edges(spark, d)
    return graph.related_tests(e, _files(spark, d), _every(e))


@query
def graph_risk_all(spark, d):
    """Risk of changing each class."""
    e = _edges(spark, d)
    starts, files = _every(e), _files(spark, d)
    found = graph.hops(e, starts, 3)
    return graph.risk(graph.impact(e, files, starts, found=found), graph.related_tests(e, files, starts, found=found))


@query
def graph_entry_points_all(spark, d):
    """Classes without subclasses below every class, within 20 hops."""
    e = _edges(spark, d)
    return graph.entry_points(e, _every(e))


for _name in ("graph_neighbours", "graph_bfs", "inheritance_closure", "graph_impact", "graph_tests", "graph_risk", "graph_entry_points"):
    SQL[f"{_name}_all"] = SQL[_name].replace(_HUBS, _EVERY).replace(_DEEP, _EVERY)


@query
def graph_stats(spark, d):
    """Edges, ends and files per workspace."""
    return graph.stats(table(spark, d, "inheritance_edges"), "workspace_id", "child", "parent", "path")


SQL["graph_stats"] = "SELECT workspace_id, count(*) AS edges, count(DISTINCT child) AS callers, count(DISTINCT parent) AS callees, count(DISTINCT path) AS files FROM inheritance_edges GROUP BY workspace_id"


@query
def graph_traversable(spark, d):
    """Names defined in at most three paths."""
    return graph.traversable(table(spark, d, "inheritance_edges").where("child is not null"), "workspace_id", "child", "path")


SQL["graph_traversable"] = "SELECT workspace_id AS scope, child AS name FROM inheritance_edges WHERE child IS NOT NULL GROUP BY ALL HAVING count(DISTINCT path) <= 3"


@query
def graph_definitions(spark, d):
    """The most trusted rows of every class, five each."""
    e = table(spark, d, "inheritance_edges").select("workspace_id", "child", "parent", "path", "line", "confidence", "source_provider").distinct()
    return graph.top_rows(e, ["workspace_id", "child"], "confidence", ["path", "line", "parent", "source_provider"], 5)


SQL["graph_definitions"] = "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, child ORDER BY confidence DESC NULLS LAST, path, line, parent, source_provider) AS rn FROM (SELECT DISTINCT workspace_id, child, parent, path, line, confidence, source_provider FROM inheritance_edges)) WHERE rn <= 5"


@query
def graph_references(spark, d):
    """One row per path, child, parent and line: the newest, then the most trusted."""
    e = table(spark, d, "inheritance_edges").select("workspace_id", "path", "child", "parent", "line", "revision", "confidence")
    return graph.upsert_references(e.where("confidence < 0.9"), e.where("not confidence < 0.9 or confidence is null"), ["workspace_id", "path", "child", "parent", "line"], "revision", "confidence")


SQL["graph_references"] = "SELECT workspace_id, path, child, parent, line, revision, confidence FROM inheritance_edges QUALIFY row_number() OVER (PARTITION BY workspace_id, path, child, parent, line ORDER BY coalesce(revision, -1) DESC, coalesce(confidence, -1) DESC) = 1"


@query
def graph_ascii(spark, d):
    """SK7: each class with its parents, rendered."""
    return graph.ascii_graph(_edges(spark, d))


SQL["graph_ascii"] = f"WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY scope, src ORDER BY dst) AS r FROM e) SELECT scope, src, src || ' -> ' || string_agg(dst, ', ' ORDER BY dst) FILTER (r <= 8) || CASE WHEN max(r) > 8 THEN ', ...' ELSE '' END AS rendered FROM n GROUP BY scope, src"


# Memory

AS_OF = "2025-11-30 00:00:00"
_WS = "trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g'))"
_FP = f"sha1(coalesce(category, '') || chr(0) || lower({_WS}))"


@query
def fingerprint(spark, d):
    """Memories by fingerprint."""
    return table(spark, d, "memories").select("id", T.fingerprint("category", "content").alias("fp"))


SQL["fingerprint"] = f"SELECT id, {_FP} AS fp FROM memories"


@query
def memory_dedupe(spark, d):
    """Repeats merged."""
    m = memory.dedupe(table(spark, d, "memories"))
    return m.withColumn("tags", F.array_join("tags", ",")).withColumn("files", F.array_join("files", ","))


SQL["memory_dedupe"] = f"""WITH m AS (SELECT *, {_FP} AS fp, coalesce(CAST(from_json(CASE WHEN json_valid(tags_json) THEN tags_json END, '["VARCHAR"]') AS VARCHAR[]), []) AS t, coalesce(CAST(from_json(CASE WHEN json_valid(related_files_json) THEN related_files_json END, '["VARCHAR"]') AS VARCHAR[]), []) AS f FROM memories),
tt AS (SELECT fp, string_agg(x, ',' ORDER BY id, k) AS tags FROM (SELECT fp, x, min_by(id, (id, k)) AS id, min_by(k, (id, k)) AS k FROM (SELECT fp, id, unnest(t) AS x, unnest(range(len(t))) AS k FROM m) GROUP BY fp, x) GROUP BY fp),
ff AS (SELECT fp, string_agg(x, ',' ORDER BY id, k) AS files FROM (SELECT fp, x, min_by(id, (id, k)) AS id, min_by(k, (id, k)) AS k FROM (SELECT fp, id, unnest(f) AS x, unnest(range(len(f))) AS k FROM m) GROUP BY fp, x) GROUP BY fp)
SELECT m.fp, min(id) AS id, count(*) AS merged, CAST(sum(coalesce(access_count, 0)) AS BIGINT) AS access_count, max(importance) AS importance, coalesce(bool_or(verified), false) AS verified, coalesce(any_value(tags), '') AS tags, coalesce(any_value(files), '') AS files
FROM m LEFT JOIN tt ON tt.fp = m.fp LEFT JOIN ff ON ff.fp = m.fp GROUP BY m.fp"""


@query
def memory_rank(spark, d):
    """Hybrid ranking with a vector."""
    row = table(spark, d, "memories").where("id = 1").select("embedding_vector").first()
    q = [float(x) for x in row[0]] if row and row[0] else None
    return memory.rank(memory.select(table(spark, d, "memories")), "shard index task", q, limit=20)


SQL["memory_rank"] = """WITH q AS (SELECT CAST(embedding_vector AS DOUBLE[]) AS v FROM memories WHERE id = 1),
m AS (SELECT id, lower(coalesce(content, '')) AS c, lower(coalesce(category, '')) AS cat, lower(coalesce(subcategory, '')) AS sub, CAST(embedding_vector AS DOUBLE[]) AS e,
list_transform(coalesce(CAST(from_json(CASE WHEN json_valid(tags_json) THEN tags_json END, '["VARCHAR"]') AS VARCHAR[]), []), lambda x: lower(coalesce(x, ''))) AS t,
list_transform(coalesce(CAST(from_json(CASE WHEN json_valid(related_files_json) THEN related_files_json END, '["VARCHAR"]') AS VARCHAR[]), []), lambda x: lower(x)) AS f, ['shard', 'index', 'task'] AS w FROM memories WHERE status = 'active'),
s AS (SELECT id, least(1.0, (len(list_filter(w, lambda x: instr(c, x) > 0)) / 3.0::DOUBLE + least(1.0, len(list_intersect(w, t)) / 3.0::DOUBLE) + CASE WHEN len(list_filter(w, lambda x: instr(cat, x) > 0)) > 0 THEN 0.4 ELSE 0 END + CASE WHEN len(list_filter(w, lambda x: instr(sub, x) > 0)) > 0 THEN 0.3 ELSE 0 END
+ CASE WHEN len(list_filter(f, lambda y: len(list_filter(w, lambda x: instr(y, x) > 0)) > 0)) > 0 THEN 0.5 ELSE 0 END) / 1.5)::DOUBLE AS k,
CASE WHEN len(e) = len(v) AND list_sum(list_transform(e, lambda x: x * x)) > 0 THEN greatest(0.0, list_sum(list_transform(list_zip(e, v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(v, lambda x: x * x))))) ELSE 0.0 END AS s FROM m, q),
z AS (SELECT id, round(CASE WHEN k > 0 AND s > 0 THEN least(1.0, k + 0.3 * s) ELSE greatest(k, 0.7 * s) END, 4) AS score, k, s FROM s)
SELECT id, score, round(k, 4) AS keyword_score, round(s, 4) AS semantic_score FROM z WHERE (k > 0 OR s > 0) AND score >= 0.3 ORDER BY score DESC, id LIMIT 20"""


@query
def memory_stats(spark, d):
    """A5: one pass of counts."""
    return memory.stats(table(spark, d, "memories"), AS_OF)


SQL["memory_stats"] = f"""WITH a AS (SELECT * FROM memories WHERE status = 'active') SELECT 'total' AS section, '' AS key, count(*) AS n FROM a HAVING count(*) > 0 UNION ALL SELECT 'category', coalesce(category, ''), count(*) FROM a GROUP BY ALL UNION ALL SELECT 'importance', coalesce(CAST(importance AS VARCHAR), ''), count(*) FROM a GROUP BY ALL
UNION ALL SELECT 'recent', '', count(*) FROM a WHERE created_at >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 7 DAY HAVING count(*) > 0 UNION ALL SELECT 'verified', '', count(*) FROM a WHERE verified HAVING count(*) > 0 UNION ALL SELECT 'archived', '', count(*) FROM memories WHERE status = 'archived' HAVING count(*) > 0"""


@query
def memory_select(spark, d):
    """Memories by status, importance, age and tags."""
    return memory.select(table(spark, d, "memories"), min_importance=3, since="2025-06-01", tags=["Cursor", "batch", "shard", "index"]).select("id")


SQL["memory_select"] = """SELECT id FROM memories WHERE status = 'active' AND importance >= 3 AND created_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00'
AND len(list_intersect(list_transform(coalesce(CAST(from_json(CASE WHEN json_valid(tags_json) THEN tags_json END, '["VARCHAR"]') AS VARCHAR[]), []), lambda x: lower(x)), ['cursor', 'batch', 'shard', 'index'])) > 0"""


@query
def memory_list(spark, d):
    """The third page by importance."""
    return memory.listing(table(spark, d, "memories"), "importance", offset=40, limit=20).select("id", "importance")


SQL["memory_list"] = "SELECT id, importance FROM memories ORDER BY importance DESC NULLS LAST, id LIMIT 20 OFFSET 40"


@query
def memory_context(spark, d):
    """The four reports of a context summary."""
    return memory.context_summary(table(spark, d, "memories"), AS_OF)


SQL["memory_context"] = f"""WITH s AS (SELECT id, created_at, CASE WHEN category = 'progress' AND created_at >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAY THEN 'recent_progress' WHEN category = 'learning' AND importance >= 4 THEN 'key_learnings' WHEN category = 'preference' THEN 'user_preferences'
WHEN category = 'mistake' AND importance >= 3 AND created_at >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 60 DAY THEN 'important_warnings' END AS section FROM memories WHERE status = 'active'),
r AS (SELECT section, row_number() OVER (PARTITION BY section ORDER BY created_at DESC NULLS LAST, id) AS rank, id FROM s WHERE section IS NOT NULL) SELECT * FROM r WHERE rank <= CASE WHEN section = 'user_preferences' THEN 10 ELSE 5 END"""


@query
def memory_advice(spark, d):
    """Advice from three angles."""
    return memory.advisory(table(spark, d, "memories"), ["shard index", "worker.py", "timeout in cursor"]).select("rank", "id", "confidence")


def _advice_sql(angles):
    """Keyword scores of each angle, the best three of each, then the best five while their lines fit."""
    parts = []
    for n, words in enumerate(angles):
        w, k = "[" + ", ".join(f"'{x}'" for x in words) + "]", len(words)
        parts.append(f"""(SELECT id, {n} AS angle, round(least(1.0, (len(list_filter({w}, lambda x: instr(c, x) > 0)) / {k}.0::DOUBLE + least(1.0, len(list_intersect({w}, t)) / {k}.0::DOUBLE) + CASE WHEN len(list_filter({w}, lambda x: instr(cat, x) > 0)) > 0 THEN 0.4 ELSE 0 END + CASE WHEN len(list_filter({w}, lambda x: instr(sub, x) > 0)) > 0 THEN 0.3 ELSE 0 END
+ CASE WHEN len(list_filter(f, lambda y: len(list_filter({w}, lambda x: instr(y, x) > 0)) > 0)) > 0 THEN 0.5 ELSE 0 END) / 1.5)::DOUBLE, 4) AS score FROM m WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 3)""")
    return f"""WITH m AS (SELECT id, lower(coalesce(content, '')) AS c, lower(coalesce(category, '')) AS cat, lower(coalesce(subcategory, '')) AS sub,
list_transform(coalesce(CAST(from_json(CASE WHEN json_valid(tags_json) THEN tags_json END, '["VARCHAR"]') AS VARCHAR[]), []), lambda x: lower(coalesce(x, ''))) AS t,
list_transform(coalesce(CAST(from_json(CASE WHEN json_valid(related_files_json) THEN related_files_json END, '["VARCHAR"]') AS VARCHAR[]), []), lambda x: lower(x)) AS f FROM memories WHERE status = 'active'),
a AS ({" UNION ALL ".join(parts)}), b AS (SELECT id, arg_min(score, angle) AS score FROM a GROUP BY id),
r AS (SELECT b.id, score, row_number() OVER (ORDER BY score DESC, b.id) AS rank, category, trim(coalesce(content, '')) AS body FROM b JOIN memories ON memories.id = b.id QUALIFY rank <= 5),
l AS (SELECT *, sum(length(rank || '. [' || category || '] ' || CASE WHEN length(body) > 200 THEN substr(body, 1, 197) || '...' ELSE body END)) OVER (ORDER BY rank) AS used, max(score) OVER () AS best FROM r)
SELECT rank, id, round(least(1.0, best * 1.2), 3)::DOUBLE AS confidence FROM l WHERE used <= 3200"""


SQL["memory_advice"] = _advice_sql([["shard", "index"], ["worker", "py"], ["timeout", "in", "cursor"]])


@query
def memory_upsert(spark, d):
    """Later memories stored or bumped onto earlier ones."""
    m = table(spark, d, "memories")
    return memory.upsert(m.where("id % 2 = 1"), m.where("id % 2 = 0")).select("fp", "id", "importance", "access_count")


SQL["memory_upsert"] = f"WITH m AS (SELECT {_FP} AS fp, id, importance, access_count, (id + 1) % 2 AS fresh FROM memories) SELECT fp, min_by(id, (fresh, id)) AS id, max(importance) AS importance, CAST(sum(CASE WHEN fresh = 0 THEN coalesce(access_count, 0) ELSE 1 END) - min(fresh) AS BIGINT) AS access_count FROM m GROUP BY fp"


@query
def memory_update(spark, d):
    """A partial update with its new fingerprint."""
    m = table(spark, d, "memories")
    changes = m.where("importance = 1").select("id", F.concat(F.lit("checked: "), "content").alias("content"), F.lit(None).cast("string").alias("category"))
    return memory.update(m, changes, ["content", "category"]).select("id", "category", F.col("content_fingerprint").alias("fp"))


SQL["memory_update"] = "WITH u AS (SELECT id, category, CASE WHEN importance = 1 AND content IS NOT NULL THEN 'checked: ' || content ELSE content END AS content FROM memories) SELECT id, category, " + _FP + " AS fp FROM u"


# History: commit messages are documents, commits are pushes


def _commits(spark, d):
    f = table(spark, d, "sync_files")
    g = f.groupBy("workspace_id", F.date_format("received_at", "yyyy-MM").alias("month"))
    paths = F.sort_array(F.collect_set("path"))
    g = g.agg(F.min(F.coalesce("client_id", F.lit(""))).alias("author"), F.max("received_at").alias("at"), paths.alias("files"))
    return g.select(F.concat_ws("/", "workspace_id", "month").alias("hash"), "author", "at", F.array_join("files", " ").alias("message"), "files")


_COMMITS = "c AS (SELECT workspace_id || '/' || strftime(received_at AT TIME ZONE 'UTC', '%Y-%m') AS hash, min(coalesce(client_id, '')) AS author, max(received_at) AS last_at, list_sort(list(DISTINCT path)) AS files, array_to_string(list_sort(list(DISTINCT path)), ' ') AS message FROM sync_files GROUP BY 1)"


def _words(ws, text):
    return "(" + " OR ".join(f"instr(lower({text}), '{w}') > 0" for w in ws) + ")"


@query
def commit_classify(spark, d):
    """Defensive and hardening commit messages."""
    c = table(spark, d, "documents").where("doc_kind = 'commit'")
    return history.classified(c, "text").select("doc_id", "is_defensive", "is_hardening")


SQL["commit_classify"] = f"SELECT doc_id, {_words(history.DEFENSIVE, 'text')} AS is_defensive, {_words(history.HARDENING, 'text')} AS is_hardening FROM documents WHERE doc_kind = 'commit'"


@query
def issue_tags(spark, d):
    """Tags of every text."""
    x = table(spark, d, "documents").select("doc_id", F.array_join(history.issue_tags(F.col("text")), ",").alias("tags"))
    return x.where("tags <> ''")


SQL["issue_tags"] = r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '(?:#|GH-|[A-Z]{2,}-)(\d+)') AS l FROM documents) SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda p: list_position(l, p[1]) = p[2]), lambda p: p[1]), ',') AS tags FROM t WHERE len(l) > 0"""


@query
def issue_extract(spark, d):
    """References by kind, and whether they close."""
    return history.issues(table(spark, d, "documents"), ["doc_id"], "text")


def _issues_sql():
    """Every kind's distinct references, and the 24 characters before the first mention of each."""
    head = {"github_pr": r"^(.*?)\b(?i:PR|pull request)\s*[#-]?", "github": r"^((?:.*?\W)??)#", "github_alt": r"^(.*?)\bGH-", "gitlab_mr": r"^((?:.*?\W)??)!", "ado": r"^(.*?)\bAB#", "jira": r"^(.*?)\b"}
    parts = []
    for kind, pattern, prefix in history.ISSUES:
        found = pattern.replace(r"(?!(?:PR|GH|AB|MR|CI|CD)-)", "")
        keep = "NOT regexp_matches(n, '^(PR|GH|AB|MR|CI|CD)-')" if kind == "jira" else "true"
        name = "n" if kind == "jira" else f"'{prefix}' || CAST(CAST(n AS BIGINT) AS VARCHAR)"
        parts.append(rf"SELECT doc_id, text, '{kind}' AS kind, {name} AS identifier, CAST(regexp_extract(n, '(\d+)$', 1) AS BIGINT) AS number, length(regexp_extract(text, '(?s){head[kind]}' || n || '\b', 1)) AS before FROM (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '{found}', 1))) AS n FROM documents) WHERE {keep}")
    return f"""WITH r AS ({" UNION ALL ".join(parts)})
SELECT doc_id, kind, identifier, min(number) AS number, bool_or(before > 0 AND regexp_matches(substr(text, greatest(before - 23, 1), least(before, 24)), '{history.CLOSING}')) AS closing FROM r GROUP BY ALL"""


SQL["issue_extract"] = _issues_sql()


@query
def cochange_topk(spark, d):
    """What changes together with the most pushed file."""
    c = _commits(spark, d)
    top = table(spark, d, "sync_files").groupBy("path").count().orderBy(F.desc("count"), "path").first()
    return history.cochange(c, top["path"] if top else "", 10)


SQL["cochange_topk"] = f"WITH {_COMMITS}, top AS (SELECT path FROM sync_files GROUP BY path ORDER BY count(*) DESC, path LIMIT 1), x AS (SELECT path AS file, unnest(files) AS other FROM c, top WHERE list_contains(files, path)) SELECT file, other, count(*) AS n FROM x WHERE other <> file GROUP BY ALL ORDER BY n DESC, file, other LIMIT 10"


@query
def file_history(spark, d):
    """History and risk of every file."""
    return history.file_history(_commits(spark, d), AS_OF).drop("first_at", "last_at")


SQL["file_history"] = f"""WITH {_COMMITS}, k AS (SELECT *, {_words(history.DEFENSIVE, 'message')} AS df, {_words(history.HARDENING, 'message')} AS hd FROM c),
x AS (SELECT unnest(files) AS file, author, last_at, df, hd FROM k), g AS (SELECT file, count(*) AS commits, count(DISTINCT author) AS authors, min(last_at) AS f, max(last_at) AS l, count(*) FILTER (df) AS defensive, count(*) FILTER (hd) AS hardening FROM x GROUP BY file),
r AS (SELECT *, greatest(0, CAST(floor((floor(epoch(l)) - floor(epoch(f))) / 86400) AS BIGINT)) AS days_active, greatest(0, floor((epoch(TIMESTAMPTZ '{AS_OF}+00') - floor(epoch(l))) / 86400)) AS age FROM g),
s AS (SELECT *, round(0.30 * defensive / commits + 0.20 * hardening / commits + 0.20 * least(1.0, commits / 50.0) + 0.15 * least(1.0, authors / 10.0) + 0.15 * exp(-age / 90.0), 4)::DOUBLE AS risk FROM r)
SELECT file, commits, authors, defensive, hardening, days_active, risk, CASE WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM s"""


@query
def dominant_author(spark, d):
    """SC11: the client that pushed most versions of each file."""
    b = table(spark, d, "sync_files").where("client_id is not null").select("path", "client_id", "sync_id")
    return history.dominant(b, "path", "sync_id", "client_id", 0, 10**15)


SQL["dominant_author"] = "WITH n AS (SELECT path, client_id, count(*) AS n_lines FROM sync_files WHERE client_id IS NOT NULL GROUP BY ALL) SELECT path, client_id, n_lines FROM n QUALIFY row_number() OVER (PARTITION BY path ORDER BY n_lines DESC, client_id) = 1"
