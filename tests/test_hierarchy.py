import random

from codeloom.operators.hierarchy import cycle_nodes, descendants, hierarchy


def brute(edges):
    up = {}
    for w, c, p in edges:
        if None not in (w, c, p):
            up.setdefault((w, c), set()).add((w, p))
    nodes = set(up) | {p for s in up.values() for p in s}
    reach = {}
    for n in nodes:
        seen, todo = set(), list(up.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        reach[n] = seen
    return nodes, up, reach


def fixture():
    rnd = random.Random(4)
    edges = [("w", "b", "a"), ("w", "c", "b"), ("w", "c", "a"), ("w", "x", "y"), ("w", "y", "x"), ("w", "z", "y"), ("w", "s", "s"), ("v", "b", "a"), ("w", "b", "a"), (None, "q", "r"), ("w", None, "r"), ("w", "q", None), ("w", "B", "a")]
    edges += [("t", f"n{i}", f"n{rnd.randrange(max(0, i - 6), i)}") for i in range(1, 24)]
    edges += [("t", f"n{rnd.randrange(24)}", f"n{rnd.randrange(24)}") for _ in range(3)]
    edges += [("d", f"m{i}", f"m{i - 1}") for i in range(1, 6)]
    return edges


def random_edges(seed):
    rnd = random.Random(seed)
    out = []
    for w in range(12):
        n = rnd.randrange(2, 14)
        out += [(f"w{w}", f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(rnd.randrange(1, 2 * n))]
    return out


def test_matches_brute_force(spark):
    edges = fixture() + random_edges(1) + [(f"{w}b", c, p) for w, c, p in random_edges(2)] + [(f"{w}c", c, p) for w, c, p in random_edges(3)]
    df = spark.createDataFrame([e + (7,) for e in edges], "workspace_id string, child string, parent string, comp int")
    nodes, up, reach = brute(edges)
    got = {(r.scope, r.node): r for r in hierarchy(df, "workspace_id", "child", "parent").collect()}
    assert set(got) == nodes
    assert {k for k, r in got.items() if r.in_cycle} == {n for n in nodes if n in reach[n]}
    assert {(r.scope, r.node) for r in cycle_nodes(df, "workspace_id", "child", "parent").collect()} == {n for n in nodes if n in reach[n]}
    for k, r in got.items():
        rooted = k not in up or any(x not in up for x in reach[k])
        assert (r.root is not None) == rooted
        if rooted:
            assert len(r.path) == r.depth + 1 and r.path[0] == r.root and r.path[-1] == k[1]
            assert all((k[0], p) in up[(k[0], c)] for p, c in zip(r.path, r.path[1:]))
            assert r.rgt - r.lft == r.n_descendants
            if r.depth:
                q = got[(k[0], r.path[-2])]
                assert q.lft < r.lft <= r.rgt <= q.rgt
    pairs = {(r.scope, r.ancestor, r.descendant) for r in descendants(df, "workspace_id", "child", "parent").collect()}
    assert pairs == {(n[0], a[1], n[1]) for n in nodes for a in reach[n]}


def test_empty(spark):
    df = spark.createDataFrame([], "workspace_id string, child string, parent string")
    assert hierarchy(df, "workspace_id", "child", "parent").count() == 0
    assert descendants(df, "workspace_id", "child", "parent").count() == 0


def test_very_deep_chains_and_loops_take_few_rounds(spark, monkeypatch):
    """100000 levels, a loop of 50000 classes and a tail below it, in a number of tables that is logarithmic in the depth."""
    import pyspark.sql.functions as F

    from codeloom.session import Scratch

    written = []
    real = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: written.append(1) or real(self, df))
    n, k = 100_000, 50_000
    chain = spark.range(1, n).select(F.lit("w").alias("ws"), F.concat(F.lit("c"), "id").alias("child"), F.concat(F.lit("c"), F.col("id") - 1).alias("parent"))
    loop = spark.range(k).select(F.lit("w").alias("ws"), F.concat(F.lit("l"), "id").alias("child"), F.concat(F.lit("l"), (F.col("id") + 1) % k).alias("parent"))
    tail = spark.range(1, 1000).select(F.lit("w").alias("ws"), F.concat(F.lit("t"), "id").alias("child"), F.when(F.col("id") > 1, F.concat(F.lit("t"), F.col("id") - 1)).otherwise(F.lit("l7")).alias("parent"))
    out = hierarchy(chain.unionByName(loop).unionByName(tail), "ws", "child", "parent", paths=False)
    got = out.groupBy("status").agg(F.count("*").alias("n"), F.max("depth").alias("deep"), F.max("rgt").alias("rgt"), F.sum("lft").alias("lfts")).collect()
    got = {r.status: r for r in got}
    assert (got["tree"].n, got["tree"].deep, got["tree"].rgt, got["tree"].lfts) == (n, n - 1, n - 1, n * (n - 1) // 2)
    assert got["cycle"].n == k and got["below_cycle"].n == 999 and got["cycle"].deep is None
    assert len(written) < 200
