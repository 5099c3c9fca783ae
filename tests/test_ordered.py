"""Sequences in range partitions against plain loops."""

import random
from collections import defaultdict

from codeloom.operators import ingest
from codeloom.operators.ordered import cut_sequences, prefix_sums
from codeloom.session import Scratch


def greedy(sizes, most, limit):
    out, items, total, batch = [], 0, 0, -1
    for s in sizes:
        if not items or items >= most or s is not None and total + max(s, 0) > limit:
            items, total, batch = 0, 0, batch + 1
        items, total = items + 1, total + max(s or 0, 0)
        out.append(batch)
    return out


def test_runs_are_cut_greedily_across_ranges(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice("abc") if rnd.random() < 0.9 else None, i, rnd.choice([0, 1, 5, 30, 99, 120, None, -4])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i long, size long")
    for parts in (1, 7, 60):
        got = defaultdict(dict)
        for r in cut_sequences(df, ["g"], ["i"], "size", 6, 100, "batch", Scratch(spark), parts).collect():
            got[r["g"]][r["i"]] = r["batch"]
        assert sum(map(len, got.values())) == 600
        for g, found in got.items():
            at = [(i, s) for x, i, s in rows if x == g]
            assert [found[i] for i, _ in at] == greedy([s for _, s in at], 6, 100)


def test_batches_never_exceed_their_bytes(spark):
    sizes = [249000, 200000, 10, 240000, 200000, 900000, 1]
    log = spark.createDataFrame([("w", f"p{i}", "upsert", "h", 1, i, s) for i, s in enumerate(sizes)], "workspace_id string, path string, op string, hash string, revision long, seq long, size long")
    got = [r["batch"] for r in ingest.coalesced(log).orderBy("seq").collect()]
    assert got == [0, 1, 1, 2, 3, 4, 5]
    assert ingest.coalesced(log.limit(0)).count() == 0


def test_prefix_sums(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice(["a", None]), i, rnd.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    for parts in (1, 9):
        got = {(r["g"], r["i"]): (r["before"], r["rank"]) for r in prefix_sums(df, ["g"], ["i"], {"before": "v", "rank": "1"}, Scratch(spark), parts).collect()}
        run = defaultdict(lambda: (0, 0))
        for g, i, v in rows:
            assert got[g, i] == run[g]
            run[g] = (run[g][0] + v, run[g][1] + 1)
    assert prefix_sums(df.limit(0), ["g"], ["i"], {"before": "v"}, Scratch(spark)).count() == 0


def test_cosine_of_odd_vectors(spark):
    from codeloom.operators.vector import topk

    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [4.0, None]), (6, [-4.0, 3.0]), (7, [6.0, 8.0])], "id long, v array<float>")
    assert [(r["id"], r["score"]) for r in topk(df, "id", "v", [3.0, 4.0], 9).collect()] == [(1, 1.0), (7, 1.0), (6, 0.0)]
    assert topk(df, "id", "v", [0.0, 0.0], 3).count() == 0 and topk(df.limit(0), "id", "v", [1.0, 0.0], 3).count() == 0
