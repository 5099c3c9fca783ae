from datetime import datetime

from codeloom.operators import compose
from pyspark.sql import functions as F


def test_context_keeps_to_the_budget(spark):
    a = spark.createDataFrame([(1, "x" * 40), (2, "y" * 40)], "rank int, text string")
    got = compose.context({"a": a, "b": a, "none": a.limit(0)}, 30).orderBy("section", "rank").collect()
    assert [(r.section, r.rank, r.used) for r in got] == [("a", 1, 10), ("a", 2, 20), ("b", 1, 30)]
    n = compose.numbered(spark.createDataFrame([("b",), ("a",), ("c",)], "k string"), F.upper("k"), ["k"], 2).collect()
    assert [(r.rank, r.text) for r in n] == [(1, "A"), (2, "B")]


def test_lookup(spark):
    t = spark.createDataFrame([("h", "u", "l", datetime(2025, 1, 2)), ("h2", "u", "m", None), ("h3", "zz", "m", None)], "token_hash string, username string, label string, expires_at timestamp")
    u = spark.createDataFrame([("u", "admin")], "username string, role string")
    assert compose.authenticated(t, u, "h", "2025-01-01").count() == 1
    assert compose.authenticated(t, u, "h", "2025-01-02").count() == 0
    assert compose.authenticated(t, u, "h2", "2099-01-01").count() == 1 and compose.authenticated(t, u, "h3", "2025-01-01").count() == 0


def test_embedding_and_diff(spark):
    df = spark.createDataFrame([("a b", "one two\nthree", "one two\nfour"), ("c", "", None), ("d", None, "x")], "p string, a string, b string")
    e = df.select(compose.hashed_embedding("a", 16).alias("v")).collect()
    assert len(e[0].v) == 16 and abs(sum(x * x for x in e[0].v) - 1) < 1e-5 and e[1].v is None and e[2].v is None
    r = [(x.r.added, x.r.removed) for x in df.select(compose.unified_diff(F.col("a"), F.col("b"), F.col("p")).alias("r")).collect()]
    assert r == [(1, 1), (0, 0), (1, 0)]
