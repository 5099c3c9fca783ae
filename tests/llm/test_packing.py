from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm.packing import allocation, containers, pack, reduce_dominated


def best(sizes, cap):
    """Fewest containers, by search."""
    sizes = sorted(sizes, reverse=True)
    if not sizes:
        return 0
    memo = {}

    def go(rest):
        if not rest:
            return 0
        if rest in memo:
            return memo[rest]
        first, others = rest[0], rest[1:]
        out = 10**9
        for k in range(len(others) + 1):
            for c in set(combinations(others, k)):
                if first + sum(c) <= cap:
                    left = list(others)
                    for x in c:
                        left.remove(x)
                    out = min(out, 1 + go(tuple(left)))
        memo[rest] = out
        return out

    return go(tuple(sizes))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=7))
def test_patterns_hold_all_and_are_near_the_best(sizes):
    counts = Counter(sizes)
    patterns, fixed = pack(dict(counts), 20)
    got = Counter()
    for p, n in patterns:
        assert sum(p) <= 20 and n > 0
        for w in p:
            got[w] += n
    assert got == counts
    made = sum(n for _, n in patterns)
    assert made <= best(sizes, 20) + 1 and fixed <= made
    spans = {}
    for w, a, b, *_ in allocation(patterns):
        spans.setdefault(w, []).append((a, b))
    for w, s in spans.items():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] == counts[w] and all(x[1] == y[0] for x, y in zip(s, s[1:]))


@settings(max_examples=400, deadline=None)
@given(st.integers(6, 24), st.lists(st.integers(1, 24), max_size=7))
def test_dominance_costs_nothing(cap, sizes):
    sizes = [w for w in sizes if w <= cap]
    fixed, left = reduce_dominated(dict(Counter(sizes)), cap)
    rest = [w for w, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + best(rest, cap) == best(sizes, cap)


def test_dominance_goes_beyond_the_largest_item():
    # 9 and 4 leave room for two small ones in many ways; 16 pairs with 4 only, 12 with 8 fills
    fixed, _ = reduce_dominated({16: 2, 12: 1, 8: 1, 9: 2, 5: 2, 4: 3}, 20)
    assert ((12, 8), 1) in fixed and ((16, 4), 2) in fixed
    fixed, left = reduce_dominated({10: 1, 6: 1, 3: 1}, 20)
    assert fixed == [((10, 6, 3), 1)] and not left


def test_large_instance_is_tight():
    counts = {w: 1000 * (1 + w % 7) for w in range(3, 500)}
    patterns, fixed = pack(counts, 512)
    tokens, made = sum(w * n for w, n in counts.items()), sum(n for _, n in patterns)
    assert fixed and made * 512 <= tokens * 1.01 + 512


def test_frames(spark):
    rows = [(i, 1 + i * 7 % 90, 0) for i in range(500)] + [(500, 1000, 0), (501, 0, 0), (502, None, 0), (503, 100, 0)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, w int")
    kinds = spark.createDataFrame([("s", 100), ("s", 100), ("m", 300), (None, 5), ("z", 0)], "container_kind string, capacity_tokens int")
    items, report = containers(df, kinds, "doc_id", "n_tokens")
    got = items.collect()
    for kind, cap in (("s", 100), ("m", 300)):
        mine = [r for r in got if r.container_kind == kind]
        fill = Counter()
        for r in mine:
            fill[r.container_id] += r.n_tokens
        assert max(fill.values()) <= cap
        for i, n, _ in rows:
            ps = sorted((r.piece_no, r.token_start, r.n_tokens) for r in mine if r.doc_id == i)
            assert sum(p[2] for p in ps) == (n or 0)
            assert len(ps) == max(1, -(-(n or 0) // cap)) and [p[1] for p in ps] == [j * cap for j in range(len(ps))]
        rep = next(r for r in report.collect() if r.container_kind == kind)
        assert rep.n_containers == len([c for c in fill if c]) and rep.least_containers <= rep.n_containers <= rep.least_containers * 1.05 + 1
    assert {r.container_kind for r in got} == {"s", "m"}
    assert containers(df.limit(0), kinds, "doc_id", "n_tokens")[0].count() == 0
    assert containers(df, kinds.limit(0), "doc_id", "n_tokens")[0].count() == 0
    two = spark.createDataFrame([("s", 100), ("s", 300)], "container_kind string, capacity_tokens int")
    items, report = containers(df, two, "doc_id", "n_tokens")
    assert {r.capacity_tokens for r in report.collect()} == {100, 300}
    fill = Counter()
    for r in items.collect():
        fill[r.capacity_tokens, r.container_id] += r.n_tokens
    assert all(v <= cap for (cap, _), v in fill.items()) and sum(fill.values()) == 2 * sum(n or 0 for _, n, _ in rows)
