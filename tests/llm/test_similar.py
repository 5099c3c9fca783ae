import numpy as np
import pytest

from codeloom.llm import similar
from codeloom.llm.similar import near_pairs, neighbours, recall
from codeloom.llm.vamana import Graph


def data(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    for i in range(0, n, 10):
        x[i + 1] = x[i] + rng.normal(size=64) * 0.1
        x[i + 2] = x[i] * 3
    x[n - 60 :] = x[0] + rng.normal(size=(60, 64)) * 0.05
    return x.astype(np.float32)


def truth(x, near):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(u @ u.T >= near)
    return {(a, b) for a, b in zip(i, j) if a < b}


def frame(spark, x):
    rows = [(i, v.tolist(), 7) for i, v in enumerate(x)]
    rows += [(9001, None, 7), (9002, [0.0] * 64, 7), (9003, [1.0] * 32, 7), (9004, [float("nan")] * 64, 7), (None, [1.0] * 64, 7), (9005, x[5].tolist(), 7), (9006, [None] * 64, 7)]
    return spark.createDataFrame(rows, "id long, vec array<float>, v int")


@pytest.mark.parametrize("options", [{}, {"shard": 300}, {"max_points": 400}])
def test_near_pairs(spark, options):
    x = data()
    got = {(r.id_a, r.id_b) for r in near_pairs(frame(spark, x), "id", "vec", 0.95, **options).collect()}
    want = truth(x, 0.95) | {(5, 9005)}
    assert len(want & got) >= 0.99 * len(want)
    edge = truth(x, 0.9499)
    assert all(p in edge or 9005 in p for p in got)


def test_neighbours_and_recall(spark):
    x = data(2500, 1)
    df = frame(spark, x)
    rows = neighbours(df, "id", "vec", 5, "id % 100 = 0", shard=400, probes=4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 2500, 100):
        mine = sorted((r.rank, r.neighbour, r.similarity) for r in rows if r.id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and q not in [m[1] for m in mine]
        s = u @ u[q]
        s[q] = -2
        hit += sum(m[2] >= np.sort(s)[-5] - 1e-4 for m in mine)
    assert hit >= 0.9 * 5 * 25
    r = recall(df, "id", "vec", 5, "id % 100 = 0", shard=400, probes=4).collect()[0]
    assert r.n_queries == 25 and r.recall >= 0.9


def test_edges(spark):
    df = frame(spark, data(100)).limit(0)
    assert near_pairs(df, "id", "vec", 0.9).count() == 0
    assert neighbours(df, "id", "vec", 3, "id % 1 = 0").count() == 0
    one = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64)], "id long, vec array<float>")
    assert [tuple(r) for r in neighbours(one, "id", "vec", 3, "id > 0").orderBy("id").collect()] == [(1, 1, 2, 1.0), (2, 1, 1, 1.0)]


def test_copies_without_a_cap(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 50)
    rows = [(i, [1.0, *([0.0] * 63)]) for i in range(300)] + [(1000 + i, np.eye(64)[i % 64].tolist()) for i in range(64)] + [(5000 + i, [1.0, 0.1, *([0.0] * 62)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    pairs = near_pairs(df, "id", "vec", 0.95)
    assert pairs.count() == pairs.select("id_a", "id_b").distinct().count() == 421 * 420 // 2
    got = {r.id: (r.class_id, r.class_size, r.n_links) for r in similar.links(df, "id", "vec", 0.95).collect()}
    assert len(got) == len(rows) and got[7] == (0, 301, 420) and got[5001] == (5000, 120, 420) and got[1001] == (1001, 1, 0)


def test_dense_ball_without_a_cap():
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(1, 64)) + rng.normal(size=(1500, 64)) * 0.02, rng.normal(size=(1500, 64))].astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(min(a, b), max(a, b)) for i, j, _ in Graph(u).build().within(u, 0.95, 32, np.arange(3000)) for a, b in zip(i.tolist(), j.tolist()) if a != b}
    want = truth(x, 0.95)
    assert len(want) > 1_000_000 and len(got & want) >= 0.99 * len(want)


def test_graph_alone():
    x = data(3000, 2)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(u).build()
    got = {(min(a, b), max(a, b)) for i, j, _ in g.within(u, 0.95, 32, np.arange(3000)) for a, b in zip(i.tolist(), j.tolist())}
    want = truth(x, 0.95)
    assert len(got & want) >= 0.98 * len(want)
    ids, sims = g.search(u[:200], 64)
    best = np.argsort(-(u[:200] @ u.T), axis=1)[:, :10]
    top = np.take_along_axis(ids, np.argsort(-sims, 1), 1)[:, :10]
    assert np.mean([len(set(p) & set(q)) / 10 for p, q in zip(top, best)]) >= 0.9


def test_recall_leaves_out_the_own_vector(spark, monkeypatch):
    """A search that finds nothing but the query itself has a recall of 0."""
    found = similar._found

    def only_own(u, *args):
        hits, classes = found(u, *args)
        return hits.where("q = rep"), classes

    monkeypatch.setattr(similar, "_found", only_own)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(7).normal(size=(200, 64)))], "id long, vec array<double>")
    assert recall(df, "id", "vec", 5, "id % 10 = 0").collect()[0].recall == 0
