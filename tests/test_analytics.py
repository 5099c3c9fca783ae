from datetime import datetime

import __spark_entry__ as entry
from codeloom.operators import graph, history, ingest, memory, observe, project
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edges(spark):
    data = [("w", "a", "b"), ("w", "b", "c"), ("w", "c", "a"), ("w", "d", "b"), ("w", "test_d", "d"), ("w", "main_x", "d"), ("w", "a", "b"), ("w", None, "b"), ("v", "a", "z")]
    return graph.edges(spark.createDataFrame([(*e, 1) for e in data], "w string, x string, y string, src int"), "w", "x", "y")


def test_graph(spark):
    e = edges(spark)
    s = spark.createDataFrame([("w", "b")], "scope string, node string")
    assert rows(graph.reach(e, s, 5)) == [("w", "b", "a", 2), ("w", "b", "c", 1)]
    assert rows(graph.reach(e, s, 1, forward=False)) == [("w", "b", "a", 1), ("w", "b", "d", 1)]
    assert ("w", "b", "b", 3) in rows(graph.reach(e, s, 5, keep_start=True))
    assert rows(graph.neighbours(e, s)) == [("w", "b", "callee", "c"), ("w", "b", "caller", "a"), ("w", "b", "caller", "d")]
    assert rows(graph.roots(e)) == [("v", "a"), ("w", "main_x"), ("w", "test_d")]
    assert rows(graph.dead(e)) == [("v", "a")]
    assert rows(graph.entry_points(e, s)) == [("w", "b", "main_x"), ("w", "b", "test_d")]
    f = spark.createDataFrame([("w", "a", "b", "p1"), ("w", "d", "b", "p2"), ("w", "test_d", "d", "tests/t.py")], "scope string, src string, dst string, path string")
    r = graph.risk(graph.impact(e, f, s), graph.related_tests(e, f, s)).collect()[0]
    assert (r.affected, r.dependents, r.blast_radius, r.files, r.n_tests, r.risk_score, r.risk) == (2, 5, 5, 3, 1, 4, "medium")
    assert graph.reach(e.limit(0), s, 3).count() == 0


def test_graph_tables(spark):
    d = spark.createDataFrame([("w", "f", "p1"), ("w", "f", "p2"), ("w", "f", "p3"), ("w", "f", "p4"), ("w", "g", "p1")], "w string, n string, p string")
    assert rows(graph.traversable(d, "w", "n", "p")) == [("w", "g")]
    old = spark.createDataFrame([("p1", "a", "b"), ("p2", "c", "d"), ("p3", "e", "f")], "path string, src string, dst string")
    new = spark.createDataFrame([("p1", "x", "y")], "path string, src string, dst string")
    assert rows(graph.replace_files(old, new, old.where("path = 'p3'"), ["path"])) == [("p1", "x", "y"), ("p2", "c", "d")]
    a = spark.createDataFrame([("k", 1, 0.5, "old"), ("q", None, None, None)], "k string, rev long, conf double, note string")
    b = spark.createDataFrame([("k", 1, 0.9, "new")], "k string, rev long, conf double, note string")
    assert {(r.k, r.note) for r in graph.upsert_references(a, b, ["k"], "rev", "conf").collect()} == {("k", "new"), ("q", None)}


def test_graph_of_every_class(spark, tmp_path):
    """The traversals start from every class, not from a few; against a search in plain Python."""
    pairs = [("w", f"c{i}", f"c{i // 2}") for i in range(1, 40)] + [("w", "c0", "c3"), ("v", "a", "c1"), ("v", "c1", "b")]
    rel = [(s, a, b, f"tests/{a}.py" if i % 5 == 0 else f"src/{a}.py") for i, (s, a, b) in enumerate(pairs)]
    spark.createDataFrame(rel, "workspace_id string, child string, parent string, path string").write.parquet(f"{tmp_path}/inheritance_edges.parquet")
    nodes = {(s, x) for s, a, b in pairs for x in (a, b)}
    up, down = {}, {}
    for s, a, b in pairs:
        up.setdefault((s, a), set()).add(b)
        down.setdefault((s, b), set()).add(a)

    def search(s, x, to, depth, keep=False):
        level, front, n = {}, {x}, 0
        while front and n < depth:
            n += 1
            front = {z for y in front for z in to.get((s, y), ()) if z not in level and (keep or z != x)}
            level |= dict.fromkeys(front, n)
        return level

    def run(name):
        return rows(entry.queries()[name](spark, str(tmp_path)))

    assert run("graph_neighbours_all") == sorted([(s, x, d, y) for s, x in nodes for d, to in (("callee", up), ("caller", down)) for y in to.get((s, x), ())])
    assert run("graph_bfs_all") == sorted((s, x, y, n) for s, x in nodes for y, n in search(s, x, down, 3).items())
    assert run("inheritance_closure_all") == sorted((s, x, y, n) for s, x in nodes for y, n in search(s, x, up, 16, True).items())
    assert run("graph_entry_points_all") == sorted((s, x, y) for s, x in nodes for y in search(s, x, down, 20) if (s, y) not in down and (s, y) in up)
    assert run("graph_tests_all") == sorted({(s, x, p) for s, x in nodes for y in {x, *search(s, x, down, 3)} for t, a, b, p in rel if t == s and y in (a, b) and p.startswith("tests/")})
    impact = {}
    for s, x in nodes:
        f, b = search(s, x, up, 2), search(s, x, down, 2)
        impact[s, x] = (len(f), len(b), len(f | b), len({p for t, c, d, p in rel if t == s and {c, d} & {x, *f, *b}}))
    assert run("graph_impact_all") == sorted((*k, *v) for k, v in impact.items())
    assert {r[:6] for r in run("graph_risk_all")} == {(*k, *v) for k, v in impact.items()}


MEMORY = "id long, category string, subcategory string, content string, importance int, created_at timestamp, tags_json string, related_files_json string, status string, verified boolean, embedding_vector array<float>, access_count long"


def memories(spark):
    t = datetime(2025, 1, 10)
    return spark.createDataFrame(
        [
            (1, "learning", None, "Use the  Cursor", 4, t, '["a","B"]', '["x.py"]', "active", True, [1.0, 0.0], 2),
            (2, "learning", None, "use the cursor ", 5, t, '["b","B"]', None, "active", None, None, None),
            (3, "mistake", "shard", None, None, None, "broken", '[]', "archived", False, [0.0, 0.0], 0),
            (4, None, None, "", 1, datetime(2024, 1, 1), None, None, "active", False, [0.0, 1.0], 7),
        ],
        MEMORY,
    )


def test_memory(spark):
    m = memories(spark)
    d = {r.id: r for r in memory.dedupe(m).collect()}
    assert d[1].merged == 2 and d[1].access_count == 2 and d[1].importance == 5 and d[1].verified and d[1].tags == ["a", "B", "b"] and d[1].files == ["x.py"]
    assert d[3].tags == [] and len(d) == 3
    got = [(r.id, r.score) for r in memory.rank(m, "cursor b").collect()]
    assert got[0][0] == 1 and got[0][1] > 0.6
    assert [r.id for r in memory.rank(m, "zzz", [0.0, 2.0]).collect()] == [4]
    assert memory.rank(m, " ").count() == 0
    s = {(r.section, r.key): r.n for r in memory.stats(m, "2025-01-12").collect()}
    assert s[("total", "")] == 3 and s[("recent", "")] == 2 and s[("archived", "")] == 1 and s[("verified", "")] == 1 and s[("category", "")] == 1
    assert [r.id for r in memory.select(m, tags=["b"]).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in memory.select(m, status=None, category="mistake").collect()] == [3]
    assert [r.id for r in memory.listing(m, "importance", offset=1, limit=2).collect()] == [1, 4]
    assert {(r.section, r.id) for r in memory.context_summary(m, "2025-01-12").collect()} == {("key_learnings", 1), ("key_learnings", 2)}
    a = memory.advisory(m, ["cursor", "b"]).collect()
    assert [r.id for r in a][0] in (1, 2) and a[0].confidence <= 1
    u = {r.id: (r.importance, r.access_count) for r in memory.upsert(m.where("id = 1"), m.where("id <> 1")).collect()}
    assert u[1] == (5, 3) and set(u) == {1, 3, 4}
    c = spark.createDataFrame([(1, "new text", None)], "id long, content string, category string")
    x = {r.id: r for r in memory.update(m, c, ["content", "category"]).collect()}
    assert x[1].content == "new text" and x[1].category == "learning" and x[2].content == "use the cursor "
    for fn in (memory.dedupe, lambda t: memory.stats(t, "2025-01-01"), lambda t: memory.rank(t, "a b")):
        assert fn(m.limit(0)).count() == 0


def test_skills(spark):
    s = spark.createDataFrame([("fix-tests", ["pytest"], "repairs tests", None), ("deploy", None, None, "ship it")], "name string, keywords array<string>, description string, when_to_use string")
    assert [(r.name, r.score) for r in memory.skill_search(s, "please repair failing tests with pytest").collect()][0] == ("fix-tests", 8)
    assert [r.score for r in memory.skill_search(s, "zzz").collect()] == [0, 0]


def test_history(spark):
    t = datetime(2025, 1, 1)
    c = spark.createDataFrame(
        [("1", "a", t, "Fix crash, closes #42 and PR 7", ["x", "y"]), ("2", "b", datetime(2025, 1, 11), "Add retry ABC-12 GH-3 see !5 AB#9", ["x", "z", "x"]), ("3", "a", t, None, None), ("4", "a", t, "prefix", ["x", "y"])],
        "hash string, author string, at timestamp, message string, files array<string>",
    )
    assert [(r.hash, r.is_defensive, r.is_hardening) for r in history.classified(c).orderBy("hash").collect()] == [("1", True, False), ("2", False, True), ("3", False, False), ("4", True, False)]
    refs = {(r.hash, r.kind, r.identifier, r.closing) for r in history.issues(c, ["hash"], "message").collect()}
    assert refs == {("1", "github", "#42", True), ("1", "github_pr", "PR-7", True), ("2", "jira", "ABC-12", False), ("2", "github_alt", "GH-3", False), ("2", "gitlab_mr", "!5", False), ("2", "ado", "AB#9", False)}
    assert [(r.other, r.n) for r in history.cochange(c, "x").collect()] == [("y", 2), ("z", 1)]
    h = {r.file: r for r in history.file_history(c, "2025-01-11").collect()}
    assert (h["x"].commits, h["x"].authors, h["x"].days_active, h["x"].defensive, h["x"].hardening) == (3, 2, 10, 2, 1)
    assert h["x"].level == "medium"
    b = spark.createDataFrame([("f", 1, "q"), ("f", 2, "q"), ("f", 3, "r"), ("f", 9, "r")], "path string, line_no int, hash string")
    assert rows(history.dominant(b, "path", "line_no", "hash", 1, 3)) == [("f", "q", 2)]


def test_ingest(spark):
    schema = "workspace_id string, path string, op string, hash string, revision long, seq long, size long"
    a = spark.createDataFrame([("w", "a", "upsert", "1", 1, 1, 10), ("w", "b", "upsert", "2", 1, 2, 10), ("w", "a", "delete", None, 2, 3, 0)], schema)
    b = spark.createDataFrame([("w", "a", "upsert", "9", 1, 9, 10), ("w", "c", "upsert", "3", 3, 4, 10), ("w", "b", "upsert", "5", 1, 8, 10)], schema)
    assert {(r.path, r.hash) for r in ingest.live(ingest.applied(a, b)).collect()} == {("b", "5"), ("c", "3")}
    assert rows(ingest.changes(b, a.where("op = 'upsert'")).select("path", "change")) == [("a", "modified"), ("b", "modified"), ("c", "new")]
    assert ingest.unchanged_skipped(b, b).count() == 0
    many = spark.createDataFrame([("w", f"p{i}", "upsert", "h", i, i, 100) for i in range(60)], schema)
    got = ingest.coalesced(many, 25, 2000).groupBy("batch").count()
    assert {r.batch: r["count"] for r in got.collect()} == {0: 20, 1: 20, 2: 20}
    w = ingest.watermarks(a.unionByName(b))
    assert [(r.accepted_revision, r.paths) for r in w.collect()] == [(3, 3)]
    late = spark.createDataFrame([("w", 1), ("w", 9), ("new", None)], "workspace_id string, client_revision long")
    assert sorted(r.new_revision for r in ingest.assigned(late, w).collect()) == [1, 4, 9]


def test_policy_and_readiness(spark):
    p = spark.createDataFrame([("src/a.py", 10), ("vendor/a.py", 10), ("tests/a.py", 200_000), ("perf_tests/a.py", 1), ("a.bin", 1), ("Makefile", 1), ("a.py", 600_000), ("x.min.js", 1)], "path string, size long")
    inc, why = ingest.index_policy("path", F.col("size"))
    assert [r.why for r in p.select(why.alias("why")).collect()] == ["included", "path_excluded", "semantic_test_file_too_large", "semantic_low_value_test_path", "extension_not_enabled", "included", "file_too_large", "path_excluded"]
    c = spark.createDataFrame([("a", "exact_only_initial_sync"), ("a", "filtered"), ("b", None), ("b", "unknown"), ("c", "deletes_only")], "k string, c string")
    assert rows(ingest.merged_coverage(c, ["k"], "c")) == [("a", "filtered"), ("b", "unknown"), ("c", "deletes_only")]
    s = spark.createDataFrame([(5, 5, 5, 1, 0, 3, "filtered", False, False, None, 5), (0, 0, 0, 0, 0, 0, "unknown", False, False, None, 0), (5, 3, 5, 1, 0, 3, "unknown", False, False, None, 5), (5, 3, 4, 1, 0, 3, "unknown", True, False, None, 6)], "accepted_revision long, semantic_revision long, exact_revision long, files long, deletes long, exact_files long, coverage string, exact_only boolean, busy boolean, error string, min_revision long")
    assert [(r.mode, r.reason) for r in ingest.readiness(s).collect()] == [("semantic_first", "filtered"), ("local_only", "empty_workspace"), ("exact_first", "semantic_index_catching_up"), ("snapshot_only", "exact_index_catching_up")]
    assert [r.freshness for r in ingest.freshness(s).collect()] == ["fresh", "fresh", "exact_fresh", "stale"]


def test_observe(spark):
    t = datetime(2025, 1, 1)
    c = spark.createDataFrame([("a", 1, t, True, 5.0, 1, 0.1, None), ("a", 2, t, False, float("nan"), 2, 0.2, "boom"), ("a", 3, datetime(2025, 1, 2), False, 20000.0, None, None, "bang"), (None, 4, t, False, None, 1, 0.1, "x"), ("b", 5, t, True, 7.0, 1, 0.1, None)], "provider string, call_id long, called_at timestamp, success boolean, duration_ms double, total_tokens int, cost_usd double, error string")
    assert {r.provider: r.streak for r in observe.failure_streak(c, ["provider"], ["called_at", "call_id"], "success").collect()} == {"a": 2, None: 1, "b": 0}
    s = {r.provider: r for r in observe.provider_stats(c, ["provider"]).collect()}
    assert s["a"].last_error == "bang" and s["a"].avg_latency == 10002.5 and s["a"].success_rate == 0.333333
    h = {(r.provider, r.le): r.n for r in observe.histogram(c, ["provider"], "duration_ms").collect()}
    assert h[("a", "5")] == 1 and h[("a", "10000")] == 1 and h[("a", "+Inf")] == 2 and h[("b", "5")] == 0
    k = observe.counters(c, F.lit("n"), {"p": F.col("provider")})
    assert {r.labels: r.value for r in k.collect()} == {'p="a"': 3.0, 'p=""': 1.0, 'p="b"': 1.0}
    assert sorted(r.line for r in observe.prometheus(k).collect())[-1] == 'n{p="b"} 1.0'
    ev = spark.createDataFrame([("u", i, datetime(2025, 1, 1, 0, 0, i)) for i in range(5)] + [("u", 9, datetime(2025, 1, 1, 0, 2)), (None, 10, t), ("v", 11, None)], "u string, i long, at timestamp")
    got = {r.i: r.allowed for r in observe.rate_limited(ev, "u", "at", "i", rate=6, burst=2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 9: True, 10: False, 11: False}
    rq = spark.createDataFrame([("k", "p", 1, datetime(2025, 1, 1)), ("k", "p", 2, datetime(2025, 1, 1, 1)), ("k", "q", 3, datetime(2025, 1, 1, 2)), ("k", "q", 4, datetime(2025, 1, 3)), (None, "p", 5, t)], "k string, p string, o long, at timestamp")
    assert {r.o: r.outcome for r in observe.idempotent(rq, "k", "p", "at", "o").collect()} == {1: "new", 2: "replay", 3: "conflict", 4: "new", 5: "new"}
    logs = spark.createDataFrame([(1, t, "ERROR", "Api", "m"), (2, datetime(2025, 1, 2), "error", "api", "m"), (3, t, "INFO", "api", "m")], "log_id long, ts timestamp, level string, component string, message string")
    assert [r.log_id for r in observe.logs(logs, "error", "API").collect()] == [2, 1]


def test_project(spark):
    f = spark.createDataFrame([("w", "a/b/c.py", 10), ("w", "a/d.py", 5), ("w", "e.md", 1), ("w", ".git/x", 2)], "w string, path string, size long")
    r = {x.dir: (x.files, x.bytes, x.truncated) for x in project.rollup(f, ["w"], "path", "size", max_depth=1).collect()}
    assert r == {"": (4, 18, False), "a": (0, 0, True), ".git": (0, 0, True)}
    assert rows(project.tree(f, ["w"], "path", 2).select("entry", "kind")) == [("a", "dir"), ("a/b", "dir"), ("a/d.py", "file"), ("e.md", "file")]
    assert [(x.extension, x.files) for x in project.extensions(f, ["w"], "path", "size", 1).collect()] == [("py", 2)]
