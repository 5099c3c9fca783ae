import math
import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from codeloom.llm.percentiles import bits_of, combine, exact_percentiles, from_sketch, latest, sketch, value_of


@given(st.lists(st.floats(allow_nan=False), min_size=2))
def test_bits_keep_the_order_and_round_trip(xs):
    a = np.array(xs, dtype="float64")
    k = bits_of(a)
    assert (value_of(k) == a).all()
    assert ((k[:, None] < k[None, :]) == (a[:, None] < a[None, :])).all()


def rows():
    rnd = random.Random(5)
    out = [("a", "m", rnd.lognormvariate(5, 2), 1, 0) for _ in range(800)] + [("a", None, float(rnd.randrange(5)), 2, 0) for _ in range(300)]
    out += [(None, "m", x, 1, 0) for x in (-1.0, 0.0, -0.0, 1e300, float("inf"), float("-inf"), None, float("nan"))] + [("z", "z", None, 1, 0), ("one", "m", 3.5, 1, 0)]
    return out


def truth(data, p):
    groups = {}
    for a, b, x, *_ in data:
        if x is not None and not math.isnan(x):
            groups.setdefault((a, b), []).append(x)
    return {(g, p): sorted(v)[max(1, math.ceil(p * len(v))) - 1] for g, v in groups.items()}


def test_exact_and_sketch(spark):
    data = rows()
    df = spark.createDataFrame(data, "provider string, model string, ms double, day int, k int")
    ps = [0.01, 0.5, 0.9, 1.0]
    want = {k: v for p in ps for k, v in truth(data, p).items()}
    got = {((r.provider, r.model), r.p): r.value for r in exact_percentiles(df, ["provider", "model"], "ms", ps).collect()}
    assert got == want
    days = sketch(df, ["day", "provider", "model"], "ms")
    est = from_sketch(combine(days, ["provider", "model"]), ["provider", "model"], ps).collect()
    assert len(est) == len(want)
    for r in est:
        x = want[((r.provider, r.model), r.p)]
        assert r.low <= x <= r.high
        if 1e-300 < abs(x) < 1e300:
            assert abs(r.value - x) <= abs(x) * 2**-8


def test_edges(spark):
    df = spark.createDataFrame([], "g string, ms double")
    assert exact_percentiles(df, ["g"], "ms", [0.5]).count() == 0
    assert from_sketch(sketch(df, ["g"], "ms"), ["g"], [0.5]).count() == 0
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (None, 1, "p"), (None, 1, "q"), (2, None, "n")], "id int, at int, v string")
    assert sorted(r.v for r in latest(df, "id", "at").collect()) == ["n", "p", "q", "y"]
