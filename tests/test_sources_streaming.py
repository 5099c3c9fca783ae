import hashlib
import json
from datetime import datetime, timedelta

from codeloom.sources import files, gitlog, store
from codeloom.streaming import jobs


def sha(t):
    return "sha256:" + hashlib.sha256(t.encode()).hexdigest()


def test_file_trees(spark, tmp_path):
    for p, t in {"a.py": "x = 1\n", "src/b.go": "package b\n", "src/c.min.js": "x", "node_modules/d.js": "x", ".github/e.yml": "x", ".hid/f.py": "x", "big.py": "x" * 5000, "g.bin": "x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    root = str(tmp_path)
    assert {r.path for r in files.grep_candidates(spark, root, max_bytes=1000).collect()} == {"a.py", "src/b.go", ".github/e.yml", "g.bin"}
    assert {r.path for r in files.grep_candidates(spark, root, ["*.py"], 1000).collect()} == {"a.py"}
    assert {r.path for r in files.index_candidates(spark, root).collect()} == {"a.py", "src/b.go", "src/c.min.js", ".github/e.yml", "big.py"}
    c = {r.path: r for r in files.contents(spark, root, files.grep_candidates(spark, root, ["a.py"])).collect()}
    assert set(c) == {"a.py"} and c["a.py"].hash == sha("x = 1\n") and c["a.py"].content == "x = 1\n"
    assert [r.path for r in files.sampled(files.listing(spark, root), 2).collect()] == [".github/e.yml", "a.py"]


def test_git_text(spark, tmp_path):
    log = tmp_path / "log.txt"
    log.write_text("\x1eabc\x1fAnn\x1f2025-01-02T03:04:05+00:00\x1fFix it\n\nbody\x1f\n\na.py\nb.py\n\x1edef\x1fBob\x1f2025-01-03T00:00:00+00:00\x1fAdd\x1f\n")
    got = {r.hash: r for r in gitlog.commits(spark, str(log)).collect()}
    assert got["abc"].files == ["a.py", "b.py"] and got["abc"].message == "Fix it\n\nbody" and got["def"].files == [] and got["def"].author == "Bob"
    v = lambda *x: spark.createDataFrame([(i,) for i in x], "value string")
    assert sorted(tuple(r) for r in gitlog.status(v(" M a.py", "R  b.py -> c.py", "")).collect()) == [("a.py", " ", "M", None), ("c.py", "R", " ", "b.py")]
    assert sorted(tuple(r) for r in gitlog.branches(v("* main", "  dev")).collect()) == [("dev", False), ("main", True)]
    b = spark.createDataFrame([("f", "a" * 40 + " 3 7 1"), ("f", "author x")], "path string, value string")
    assert [tuple(r) for r in gitlog.blame(b, "path").collect()] == [("f", 7, "a" * 40)]
    d = spark.createDataFrame([("f", "+++ b/f"), ("f", "+x"), ("f", "-y"), ("f", " z")], "path string, value string")
    assert [tuple(r) for r in gitlog.diff_counts(d, ["path"]).collect()] == [("f", 1, 1)]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.read("t") is None
    s.write("t", spark.range(3))
    s.write("t", spark.range(5), None)
    assert s.read("t").count() == 5
    o = store.objects(spark.createDataFrame([("a",), ("a",), (None,), ("bé",)], "content string"))
    assert {(r.content, r.size) for r in o.collect()} == {("a", 1), ("bé", 3)}
    a = spark.createDataFrame([(datetime(2025, 1, 1), "me", "act", "x" * 500, None, "ok", None)], "ts timestamp, actor string, action string, target string, ip string, outcome string, extra string")
    store.audit(a, str(tmp_path / "audit"))
    store.audit(a, str(tmp_path / "audit"))
    got = spark.read.csv(str(tmp_path / "audit")).collect()
    assert len(got) == 2 and len(got[0][3]) == 200


def change(path, text, rev, seq, op="upsert", ws="w", bad=False):
    return {"workspace_id": ws, "path": path, "op": op, "hash": "nope" if bad else sha(text) if text is not None else None, "revision": rev, "seq": seq, "size": len(text or ""), "content": text}


def test_sync_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps(c) for c in [change("a", "1", 1, 1), change("./b", "2", 1, 2), change("c", "x", 1, 3, bad=True), change("../d", "y", 1, 4)]))
    s = store.Store(spark, str(tmp_path / "s"))
    go = lambda: jobs.run(jobs.changes(spark, str(src), 1), jobs.sync(s), str(tmp_path / "cp")).awaitTermination()
    go()
    assert {(r.path, r.op) for r in s.read("snapshot").collect()} == {("a", "upsert"), ("b", "upsert")} and sorted(r.path for r in s.read("refused").collect()) == ["../d", "c"]
    (src / "2.json").write_text("\n".join(json.dumps(c) for c in [change("a", None, 5, 5, op="delete"), change("b", "old", 0, 6)]))
    go()
    go()
    assert {(r.path, r.op, r.content) for r in s.read("snapshot").collect()} == {("a", "delete", None), ("b", "upsert", "2")}
    assert [(r.workspace_id, r.accepted_revision) for r in s.read("watermarks").collect()] == [("w", 5)]


def collected(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return spark.table(name)


def test_stateful_streams(spark, tmp_path):
    t = datetime(2025, 1, 1)
    ev = [{"u": "a", "i": i, "at": (t + timedelta(seconds=i)).isoformat(), "k": "k", "p": "p" if i < 3 else "q"} for i in range(6)]
    src = tmp_path / "ev"
    src.mkdir()
    for n in range(3):
        (src / f"{n}.json").write_text("\n".join(json.dumps(e) for e in ev[2 * n : 2 * n + 2]))
    stream = lambda: spark.readStream.schema("u string, i long, at timestamp, k string, p string").option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(src))
    got = {r.o: r.allowed for r in collected(spark, jobs.limited(stream(), "u", "at", "i", 6, 2), "lim").collect()}
    assert sum(got.values()) == 2 and len(got) == 6
    out = {r.o: r.outcome for r in collected(spark, jobs.judged(stream(), "k", "p", "at", "i"), "idem").collect()}
    assert sorted(out.values()).count("new") == 1 and "conflict" in out.values() and "replay" in out.values()
    assert collected(spark, jobs.deduplicated(stream(), ["k"], "at", "1 minute"), "dd").count() == 1
    assert {r.n for r in collected(spark, jobs.windowed(stream(), "at", "1 minute", ["u"]), "win", "complete").collect()} == {6}
    assert {r.n for r in collected(spark, jobs.sessions(stream(), "at", "30 seconds", ["u"]), "ses", "complete").collect()} == {6}


def test_memory_stream(spark, tmp_path):
    src = tmp_path / "m"
    src.mkdir()
    schema = "id long, category string, content string, importance int, access_count long"
    row = {"category": "c", "content": "same", "importance": 1, "access_count": 0}
    s = store.Store(spark, str(tmp_path / "s"))
    for n in range(2):
        (src / f"{n}.json").write_text(json.dumps({"id": n, **row, "importance": n}))
        jobs.run(jobs.changes(spark, str(src), 1, schema), jobs.remember(s), str(tmp_path / "cp")).awaitTermination()
    assert [(r.id, r.importance, r.access_count) for r in s.read("memories").collect()] == [(0, 1, 1)]


def test_vector_index(spark, tmp_path):
    from codeloom.sources.vectors import VectorIndex

    ix = VectorIndex(spark, str(tmp_path / "ix"), "m", 2)
    schema = "workspace_id string, path string, chunk_id string, vector_id long, hash string, embedding array<double>"
    none = spark.createDataFrame([], "workspace_id string, path string")
    assert ix.health() == "missing" and ix.search([1.0, 0.0], 3).count() == 0
    rows = [("w", "a", "a1", 1, "h1", [2.0, 0.0]), ("w", "a", "a1", 2, "h1", [0.0, 3.0]), ("w", "b", "b1", 3, "h2", [1.0, 1.0]), ("v", "c", "c1", 4, "h3", [5.0, 0.0]), ("w", "d", None, 5, "h", [1.0, 0.0]), ("w", "e", "e1", 6, "h", [0.0, 0.0]), ("w", "f", "f1", 7, "h", [1.0])]
    ix.update(spark.createDataFrame(rows, schema), none, 3)
    assert ix.health() == "valid" and ix.health(4) == "stale" and VectorIndex(spark, str(tmp_path / "ix"), "other", 2).health() == "invalid"
    assert [(r.vector_id, r.score) for r in ix.search([1.0, 0.0], 9).collect()] == [(4, 1.0), (3, 0.707107), (2, 0.0)]
    assert [r.vector_id for r in ix.search([1.0, 0.0], 1, "w").collect()] == [3]
    files = spark.createDataFrame([("w", "a", "h1"), ("w", "b", "new"), ("w", "z", "h9")], "workspace_id string, path string, hash string")
    assert {r.path for r in ix.pending(files).collect()} == {"b", "z"}
    ix.update(spark.createDataFrame([("w", "b", "b2", 9, "new", [0.0, 1.0])], schema), spark.createDataFrame([("v", "c")], none.schema), 2)
    assert {r.chunk_id for r in ix.rows().collect()} == {"a1", "b2"} and ix.metadata()["revision"] == 3


def test_jobs_go_on_where_they_stopped(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "j"))
    job = jobs.Job(s, "out", 4)
    calls = []

    def work(df):
        calls.append(1)
        if len(calls) == 2:
            job.set("paused")
        return df.selectExpr("id", "id * 2 as twice")

    assert job.run(spark.range(40), ["id"], work) == "paused" and s.read("out") is None and len(calls) == 2
    assert job.run(spark.range(40), ["id"], work) == "done" and len(calls) == 4
    assert {(r.id, r.twice) for r in s.read("out").collect()} == {(i, 2 * i) for i in range(40)}


def test_fan_out(spark):
    got = []
    sink = jobs.fan_out(lambda d, n: got.append(("a", d.count())), lambda d, n: 1 / 0, lambda d, n: got.append(("b", d.count())))
    try:
        sink(spark.range(3), 0)
        raise AssertionError("the failure is raised")
    except ZeroDivisionError:
        pass
    assert got == [("a", 3), ("b", 3)]
