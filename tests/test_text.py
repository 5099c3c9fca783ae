import fnmatch
import re

import pytest

from codeloom.functions import planner
from codeloom.functions import text as T
from codeloom.operators import symbols, text, transform, vector
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lines_and_edges(spark):
    df = spark.createDataFrame([("a", "x\r\ny\n\nz\n", 1), ("b", "", 1), ("c", None, 1), ("d", "one", 1), ("d", "one", 1)], "k string, t string, line_no int")
    assert rows(text.lines(df, ["k"], "t")) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, ""), ("a", 4, "z"), ("d", 1, "one"), ("d", 1, "one")]
    assert text.lines(df.limit(0), ["k"], "t").count() == 0


@pytest.mark.parametrize("pattern", ["*.py", "a?c", "src/*/x[0-9].go", "[!a]*", "**", "x.y+z", "[abc"])
def test_globs_like_the_library(pattern):
    for name in ("a.py", "src/b.py", "abc", "src/q/x1.go", "x.y+z", "bcd", "[abc", "a\nb"):
        assert bool(re.search(T.glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern), name


def test_globs_on_paths(spark):
    df = spark.createDataFrame([("src/a.py",), ("b.go",), (None,)], "p string")
    got = df.select("p", T.matches_glob("p", ["*.py"]).alias("a"), T.matches_glob("p", ["src/*"]).alias("b"), T.matches_either("p", ["src/*"]).alias("c"), T.matches_glob("p", []).alias("d")).collect()
    assert [tuple(r) for r in got] == [("src/a.py", True, True, True, True), ("b.go", False, False, False, True), (None, None, None, None, True)]


def test_grep_context_rank_and_merge(spark):
    t = "one\ncursor here\nthree\nmycursors\nfive\nsix\nseven\neight\nnine\nCURSOR"
    df = spark.createDataFrame([("f", t), ("g", None), ("h", "nothing")], "path string, t string")
    hits = text.grep(df, ["path"], "t", "cursor", context=1).collect()
    assert [(r.line_no, r.penalty) for r in hits] == [(10, 0), (2, 0), (4, 1)]
    assert (hits[1].before, hits[1].after) == (["one"], ["three"])
    assert rows(text.merged(text.matches(text.lines(df, ["path"], "t"), "cursor"), ["path"], 1)) == [("f", 2, 4, 2), ("f", 10, 10, 1)]
    assert text.grep(df, ["path"], "t", "c.rsor", regex=True).count() == 3
    assert text.grep(df, ["path"], "t", "c.rsor", regex=True, case_sensitive=True).count() == 2
    assert text.grep(df, ["path"], "t", "%", limit=None).count() == 0


def test_regex_span(spark):
    df = spark.createDataFrame([("ab12cd34",), ("none",), (None,)], "line string")
    got = df.select(T.line_span("line", r"\d+", regex=True).alias("s")).collect()
    assert [(r.s.start, r.s.stop) if r.s else None for r in got] == [(2, 4), None, None]


def test_token_overlap(spark):
    df = spark.createDataFrame([("src/b.py", "def request_middleware(chain):\nrequest only\n"), ("tests/a.py", "request middleware chain\n")], "path string, t string")
    got = text.token_overlap(df, ["path"], "t", ["request", "Middleware", "chain", " "], "path").collect()
    assert [(r.path, r.score) for r in got] == [("src/b.py", 4.5), ("tests/a.py", 3.0)]


def test_outline(spark):
    t = "# A\n## B\n```\n# no\n```\n### C\n## D\n#no\n# E"
    got = text.outline(text.lines(spark.createDataFrame([("f", t)], "p string, t string"), ["p"], "t"), ["p"]).orderBy("line_no").collect()
    assert [(r.level, r.title, r.parent) for r in got] == [(1, "A", None), (2, "B", "A"), (3, "C", "B"), (2, "D", "A"), (1, "E", None)]


def test_paths(spark):
    cases = {"./a//b.py": "a/b.py", "a\\b": "a/b", "/x": None, "../x": None, "a/../b": None, "": None, "C:/x": None, "a/./b": "a/b", ".": None}
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert [r.p for r in df.where(~T.normal_path("p").eqNullSafe(F.col("want"))).collect()] == []
    t = spark.createDataFrame([("tests/a.py", True, True), ("src/test_x.py", True, True), ("a.spec.ts", False, True), ("test.py", False, True), ("src/FooTest.java", True, True), ("contest/a.py", False, False)], "p string, a boolean, b boolean")
    assert t.where((T.is_test_path("p") != F.col("a")) | (T.is_test_like("p") != F.col("b"))).count() == 0


def test_symbols(spark):
    code = "public class ReplicaManager {\nobject ReplicaManager\n  def ReplicaManager(x)\nasync  def run():\nfunc replicaManagerX()\nclassy no"
    ls = text.lines(spark.createDataFrame([("f.x", code)], "path string, t string"), ["path"], "t")
    s = symbols.symbols(ls, ["path"])
    assert [(r.name, r.kind) for r in s.orderBy("line_start").collect()] == [("ReplicaManager", "class"), ("ReplicaManager", "object"), ("ReplicaManager", "def"), ("run", "async def"), ("replicaManagerX", "func")]
    got = symbols.search(s, "ReplicaManager", "path").collect()
    assert [(r.kind, r.line_start) for r in got] == [("class", 1), ("def", 3), ("object", 2)] or got[0].kind == "class"
    assert len(got) == 3 and all(r.score == 1.0 for r in got)
    assert [r.score for r in symbols.search(s, "replica", "path").collect()] == [0.9] * 4
    assert symbols.search(s, "manager", "path", fuzzy=False).count() == 0
    n = spark.createDataFrame([("write_report",), ("write_reports",), ("zzz",), (None,)], "n string")
    assert n.where(symbols.fuzzy_score(F.col("n"), "wirte_report") >= 0.5).count() == 2
    r = {x.n: x.s for x in n.select("n", symbols.weighted_ratio(F.col("n"), "write report").alias("s")).collect()}
    assert r["write_report"] > 90 > r["zzz"] and r[None] == 0


def test_edges_from_text(spark):
    code = "import os\nfrom a.b import c\ndef caller(x):\n    target(x)\n    if (y): helper(1)\nclass Dog(Animal, metaclass=Meta):\n    pass\npublic class P extends Q implements R, S<T> {\nimport { z } from './w'"
    ls = text.lines(spark.createDataFrame([("f", code)], "path string, t string"), ["path"], "t")
    assert {(r.caller, r.callee) for r in symbols.call_edges(ls, ["path"]).collect()} >= {("caller", "target"), ("caller", "helper")}
    assert {(r.child, r.parent, r.edge_type) for r in symbols.inheritance(ls, ["path"]).collect()} == {("Dog", "Animal", "inherits"), ("Dog", "Meta", "metaclass"), ("P", "Q", "extends"), ("P", "R", "implements"), ("P", "S", "implements")}
    assert {r.imported for r in symbols.imports(ls, ["path"]).collect()} == {"os", "a.b", "./w"}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a", "x"), (2, [2.0, 2.0], "b", "x y"), (3, None, "a", None), (4, [0.0, 0.0], "a", "y"), (5, [1.0], "a", "y"), (6, [3.0, 0.0], "b", "Y")], "id long, v array<double>, kind string, content string")
    assert [(r.id, r.score) for r in vector.topk(df, "id", "v", [1.0, 0.0], 5).collect()] == [(1, 1.0), (6, 1.0), (2, 0.707107)]
    assert [r.id for r in vector.topk(df, "id", "v", [1.0, 0.0], 5, F.col("kind") == "b").collect()] == [6, 2]
    assert vector.topk(df, "id", "v", [0.0, 0.0], 5).count() == 0
    k = vector.keyword(df, "id", "content", "y", 2)
    assert [r.id for r in k.collect()] == [2, 4]
    fused = vector.rrf({"k": k, "v": vector.topk(df, "id", "v", [1.0, 0.0], 5)}, "id").collect()
    assert fused[0].id == 2 and fused[0].found_in == ["k", "v"]
    assert [(r.id, r.source) for r in vector.boosted(k, vector.topk(df, "id", "v", [1.0, 0.0], 5), ["id"], 3).collect()] == [(2, "boost"), (4, "boost"), (1, "vector")]
    assert vector.rerank(k).columns[-1] == "rerank_score"
    assert vector.variants("queries") == ["queri", "queries", "query", "querie"] or set(vector.variants("queries")) == {"queries", "query", "queri", "querie"}


@pytest.mark.parametrize(
    ("q", "mode"),
    [("", "semantic"), ("''", "semantic"), ("'abc def'", "text"), ("def foo", "text"), ("ab", "text"), ("return", "text"), ("MAX_SIZE", "text"), ("a/b", "text"), ("foo(x)", "text"), ("UserService", "symbol"), ("a.b_c", "symbol"), ("user login flow", "hybrid"), ("how does the login flow of users work", "semantic"), (None, "semantic"), ("todo", "text"), ("x-y", "text"), ("func", "text"), ("and", "text"), ("else", "symbol"), ("while", "symbol"), ("'\"x\"'", "text"), ("\"a \" b\"", "text"), ("src\\\\a.py", "text"), ("the usual", "hybrid")],
)
def test_modes(spark, q, mode):
    assert spark.createDataFrame([(q,)], "q string").select(planner.mode_column(F.col("q"))).first()[0] == mode


def test_plans(spark):
    rows = [("UserService", "symbol", "exact_symbol", "local_exact_index"), ("src/a.py", "semantic", "file_path", "exact_line_fts"), ("x", "references", "references", "lsp"), ("x y", "hybrid", "hybrid", "local_exact_index"), ("x", "other", "semantic", "semantic_vector")]
    df = spark.createDataFrame(rows, "q string, mode string, want string, first string").withColumn("intent", planner.intent_column(F.col("q"), F.col("mode")))
    got = df.withColumn("plan", planner.plan_column(F.col("intent"))).collect()
    assert all(r.intent == r.want and r.plan.providers[0] == r["first"] for r in got)
    assert spark.createDataFrame([("a.*b", "text")], "q string, mode string").select(planner.intent_column(F.col("q"), F.col("mode"), regex=True)).first()[0] == "regex_text"


SOURCES = [
    ("a.go", "func (r *Ring) Push(x int) {\ntype Ring struct {\ntype Sink interface {\nfunc New() *Ring {", {("Push", "method"), ("Ring", "struct"), ("Sink", "interface"), ("New", "func")}),
    ("a.rs", "pub fn run(x: u8) -> u8 {\nstruct Pool {\nimpl<T> Drop for Pool<T> {\npub(crate) async fn go() {\ntrait Sink {", {("run", "fn"), ("Pool", "struct"), ("Pool", "impl"), ("go", "fn"), ("Sink", "trait")}),
    ("A.java", "public class A extends B {\n    public static List<String> names(int x) throws Foo {\n    private int size() {\n        return size();\n        if (a) {\n    void put(String k,\npublic record Point(int x) {", {("A", "class"), ("names", "method"), ("size", "method"), ("put", "method"), ("Point", "record")}),
    ("a.js", "export default class Cart {\n  async load(id) {\n    if (id) {\nconst add = (a, b) => a + b;\nexport const go = async x => x;\nlet f = function (a) {\nasync function run() {\n  for (const a of b) {", {("Cart", "class"), ("load", "method"), ("add", "function"), ("go", "function"), ("f", "function"), ("run", "function")}),
    ("a.cpp", "class Ring final : public Base {\nstatic int push(Ring *r, int x)\nnamespace core {\nint Ring::size() const {\n  return size();\nstruct Node {", {("Ring", "class"), ("push", "function"), ("core", "namespace"), ("Ring::size", "function"), ("Node", "struct")}),
    ("a.py", "class A(B):\n    def f(self):\nasync def g():\n    return f(x)\n", {("A", "class"), ("f", "def"), ("g", "async def")}),
]


@pytest.mark.parametrize(("path", "body", "want"), SOURCES)
def test_declarations_by_language(spark, path, body, want):
    df = spark.createDataFrame([(path, n, x) for n, x in enumerate(body.split("\n"), 1)], "path string, line_no long, line string")
    assert {(r["name"], r.kind) for r in symbols.symbols(df, ["path"]).collect()} == want


def test_bases_of_other_languages(spark):
    lines = ["class Ring final : public Base, private Pool<int> {", "impl Drop for Ring {", "class A(B, metaclass=M):", "struct P : virtual public Q"]
    df = spark.createDataFrame([("a", n, x) for n, x in enumerate(lines, 1)], "path string, line_no long, line string")
    got = {(r.child, r.parent, r.edge_type) for r in symbols.inheritance(df, ["path"]).collect()}
    assert got == {("Ring", "Base", "inherits"), ("Ring", "Pool", "inherits"), ("Ring", "Drop", "impl"), ("A", "B", "inherits"), ("A", "M", "metaclass"), ("P", "Q", "inherits")}


def test_debounce_queue_buffer_and_chain(spark):
    from codeloom.operators import ingest, observe

    e = spark.createDataFrame([("a", 0, 1, "upsert"), ("a", 500, 2, "delete"), ("a", 2000, 3, "upsert"), ("b", None, 4, "upsert")], "path string, at long, seq long, op string")
    assert {(r.path, r.burst, r.events, r.op) for r in ingest.debounced(e, ["path"], "at", "seq", "op").collect()} == {("a", 0, 2, "delete"), ("a", 1, 1, "upsert"), ("b", 0, 1, "upsert")}
    log = spark.createDataFrame([("a", "add", 1), ("a", "ack", 1), ("a", "add", 2), ("b", "add", 1), ("b", "fail", 1), ("c", "add", 1), ("c", "ack", 1)], "path string, event string, revision long")
    assert {r.path: r.state for r in ingest.queue_state(log, ["path"]).collect()} == {"a": "pending", "b": "retry", "c": "accepted"}
    x = spark.createDataFrame([(None if i % 2 else "k", i) for i in range(100)], "k string, i long")
    assert {(r.k, r.i, r.dropped) for r in observe.newest(x, ["k"], ["i"], 2).collect()} == {("k", 98, 48), ("k", 96, 48), (None, 99, 48), (None, 97, 48)}
    assert observe.newest(x.limit(0), ["k"], ["i"], 2).count() == 0
    got = observe.first_provider({"a": x.where("i < 0").select("k"), "b": x.where("i < 3").select("k"), "c": x.select("k")}, ["k"]).collect()
    assert {(r.k, r.provider, r.hits) for r in got} == {("k", "b", 2), (None, "b", 1)}


def test_tests_by_name_and_code_graph(spark):
    from codeloom.operators import graph

    nodes = spark.createDataFrame([("w", "RingBuffer"), ("w", "Pool")], "scope string, node string")
    files = spark.createDataFrame([("w", "a/tests/test_ring_buffer.py"), ("w", "a/RingBufferTest.java"), ("w", "a/pool.py"), ("v", "tests/pool.py")], "ws string, path string")
    assert {(r.node, r.path) for r in graph.tests_by_name(nodes, files, "ws", "path").collect()} == {("RingBuffer", "a/tests/test_ring_buffer.py"), ("RingBuffer", "a/RingBufferTest.java")}
    rows = spark.createDataFrame([("w", "A", "B", "x/y/a.py"), ("w", "B", "C", "z/b.py"), ("w", "B", "C", "z/b.py"), (None, "B", "C", "z/b.py")], "ws string, c string, p string, path string")
    assert {(r.from_dir, r.to_dir, r.edges) for r in graph.code_graph(rows, "ws", "c", "p", "path").collect()} == {("x/y", "z", 1), ("z", None, 1)}
