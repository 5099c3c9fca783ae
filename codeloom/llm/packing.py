"""Fill containers of fixed capacity: dominance reduction, then best fit, over the histogram of sizes.

Sizes are integers of at most the capacity (a larger item is cut into full containers and a remainder), so the
instance is a histogram of at most ``capacity`` counts however many items there are. On it:

1. Dominance (Martello and Toth): for every item left, a set of at most three items with it that dominates every other
   set with it is fixed: the item alone where nothing fits, with the largest that fits where no two do, where it fills
   the container, or where it is no smaller than any pair, and a triple that covers every pair. Fixing shrinks the
   instance; it is repeated over all sizes until nothing is dominated.
2. Best fit, largest size first, on the rest, for all items of one size at a time.

The packing is a short list of patterns (sizes in a container, number of containers). Items are then matched to it
at scale: each gets its rank within its size by prefix sums over range partitions, so that no size, however common,
lies in one task; patterns own ranges of ranks.

Defined results
- Items of size 0 or null take no space: they come out in container 0 of their kind with 0 tokens.
- Only an item larger than the capacity is split; its pieces are numbered from 0 with their first token.
- Equal sizes are exchangeable and are placed in the order of their ids. Kinds that are null and capacities that are null
  or below 1 have no containers. A kind with several capacities is packed once for each; repeated rows count once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.ordered import prefix_sums
from codeloom.session import Scratch, bounded_broadcast


class Stock:
    """Items left by size, with the sizes in order."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {w: n for w, n in counts.items() if n > 0 and 0 < w <= capacity}
        self.sizes = sorted(self.left)

    def take(self, pattern: tuple[int, ...], n: int) -> None:
        for w, k in Counter(pattern).items():
            self.left[w] -= k * n
            if not self.left[w]:
                del self.left[w]
                del self.sizes[bisect_left(self.sizes, w)]

    def most(self, pattern: tuple[int, ...]) -> int:
        """How often a pattern can be taken."""
        return min(self.left.get(w, 0) // k for w, k in Counter(pattern).items())

    def largest(self, room: int, used: tuple[int, ...]) -> int | None:
        """The largest size up to ``room`` of which an item is left beside those used."""
        i = bisect_right(self.sizes, room) - 1
        while i >= 0 and self.left[self.sizes[i]] <= used.count(self.sizes[i]):
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def smallest(self, n: int, used: tuple[int, ...], above: int = 0) -> list[int]:
        """The n smallest items larger than ``above`` beside those used."""
        out: list[int] = []
        i = bisect_right(self.sizes, above)
        while i < len(self.sizes) and len(out) < n:
            w = self.sizes[i]
            out += [w] * min(n - len(out), self.left[w] - used.count(w))
            i += 1
        return out

    def best_pair(self, room: int, used: tuple[int, ...]) -> int:
        """The greatest sum up to ``room`` of two items beside those used."""
        s = np.array([w for w in self.sizes if self.left[w] > used.count(w)], dtype=np.int64)
        twice = np.array([self.left[int(w)] - used.count(int(w)) >= 2 for w in s], dtype=bool)
        i = np.searchsorted(s, room - s, side="right") - 1
        i = np.minimum(i, np.arange(len(s)) - ~twice)  # the smaller of the two, which may be equal
        ok = i >= 0
        return int((s[ok] + s[i[ok]]).max()) if ok.any() else 0


def dominating(stock: Stock, w: int, capacity: int) -> tuple[int, ...] | None:
    """A set of at most three items with ``w`` that dominates every other set with it: each of these can be split
    so that every part is no larger than an item of the set. None if there is none of the kinds tested."""
    room = capacity - w
    least = stock.smallest(3, (w,))
    fitting = sum(sum(least[: i + 1]) <= room for i in range(len(least)))
    if not fitting:
        return (w,)
    a = stock.largest(room, (w,))
    if fitting == 1 or a == room:
        return (w, a)
    if fitting > 2:
        return None
    if a >= sum(least[:2]) and a >= stock.best_pair(room, (w,)):
        return (w, a)
    b = stock.largest(room - a, (w, a))
    if b is None:
        return None
    # every pair that fits has no item above a; if no two items above b fit, a and b cover both of its items
    above = stock.smallest(2, (w,), b)
    return (w, a, b) if len(above) < 2 or sum(above) > room else None


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Patterns fixed by dominance and the counts that remain. Every remaining size is tested, largest first, until a
    whole round fixes nothing; taking a set away leaves it dominating for the next item of the size."""
    stock = Stock(counts, capacity)
    fixed: list[tuple[tuple[int, ...], int]] = []
    more = True
    while more:
        more = False
        for w in sorted(stock.left, reverse=True):
            while w in stock.left and (pattern := dominating(stock, w, capacity)):
                n = stock.most(pattern)
                fixed.append((pattern, n))
                stock.take(pattern, n)
                more = True
    return fixed, stock.left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by decreasing size of what remains; open containers are kept by free space."""
    free: dict[int, list[list]] = {}
    spaces: list[int] = []
    closed: list[tuple[tuple[int, ...], int]] = []

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        if n <= 0:
            return
        if space == 0:
            closed.append((pattern, n))
            return
        if space not in free:
            free[space] = []
            insort(spaces, space)
        free[space].append([pattern, n])

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            i = bisect_left(spaces, w)
            if i == len(spaces):
                k = min(capacity // w, n)
                m = n // k
                put(capacity - k * w, (w,) * k, m)
                n -= k * m
                continue
            space = spaces[i]
            pattern, m = free[space].pop()
            k = min(space // w, n)
            use = min(m, n // k)
            put(space - k * w, pattern + (w,) * k, use)
            n -= k * use
            if m > use:
                free[space].append([pattern, m - use])
            if not free[space]:
                del free[space]
                spaces.remove(space)
    return closed + [(p, n) for s in free.values() for p, n in s]


def pack(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Patterns with their number of containers, and how many containers dominance fixed."""
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity), sum(n for _, n in fixed)


def allocation(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, last rank + 1, first container, items of the size in each container)."""
    out, at, rank = [], 1, Counter()
    for pattern, n in patterns:
        for w, k in Counter(pattern).items():
            out.append((w, rank[w], rank[w] + n * k, at, k))
            rank[w] += n * k
        at += n
    return out


def containers(sized: DataFrame, kinds: DataFrame, item_id: str, size: str) -> tuple[DataFrame, DataFrame]:
    """(items: container_kind, capacity_tokens, container_id, item_id, piece_no, token_start, n_tokens; one report row per
    kind and capacity).

    ``kinds`` has container_kind and capacity_tokens; it is a short list of capacities, read to the driver.
    """
    spark = sized.sparkSession
    scratch = Scratch(spark)
    rows = kinds.select("container_kind", F.col("capacity_tokens").cast("int").alias("c")).where("container_kind is not null and c > 0").distinct().orderBy("container_kind", "c").collect()
    caps = [(r["container_kind"], r["c"]) for r in rows]
    item = sized.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("w"))
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("cap")) for k, c in caps])) if caps else None
    if kind is None:
        empty = item.limit(0).select(F.lit("").alias("container_kind"), F.lit(0).alias("capacity_tokens"), F.lit(0).cast("long").alias("container_id"), F.col("item_id").alias(item_id), F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("n_tokens"))
        return empty, spark.createDataFrame([], REPORT)
    item = scratch.write(item)
    pieces = item.select("item_id", "w", kind.alias("k")).select("item_id", F.col("k.kind").alias("kind"), F.col("k.cap").alias("cap"), "w")
    pieces = pieces.withColumn("piece_no", F.explode(F.expr("sequence(0L, greatest(0L, cast(ceil(w / cap) as long) - 1))")))
    pieces = pieces.select("item_id", "kind", "cap", "piece_no", (F.col("piece_no") * F.col("cap")).alias("token_start"), F.least(F.col("cap"), F.col("w") - F.col("piece_no") * F.col("cap")).alias("w"))
    hist = pieces.where("w > 0").groupBy("kind", "cap", "w").agg(F.count("*").alias("n")).collect()  # at most one row per kind and size up to the capacity
    alloc, report = [], []
    for k, cap in caps:
        counts = {r["w"]: r["n"] for r in hist if r["kind"] == k and r["cap"] == cap}
        patterns, fixed = pack(counts, cap)
        alloc += [(k, cap, *a) for a in allocation(patterns)]
        tokens, made = sum(w * n for w, n in counts.items()), sum(n for _, n in patterns)
        report.append((k, cap, sum(counts.values()), tokens, made, -(-tokens // cap), fixed, round(1 - tokens / (made * cap), 6) if made else 0.0))
    table = spark.createDataFrame(alloc, "kind string, cap long, w long, r0 long, r1 long, first long, per long")
    ranked = prefix_sums(pieces.where("w > 0"), ["kind", "cap", "w"], ["item_id", "piece_no"], {"rank": "1"}, scratch)
    placed = ranked.join(bounded_broadcast(table, 200_000), ["kind", "cap", "w"]).where("rank >= r0 and rank < r1")
    placed = placed.select("kind", "cap", (F.col("first") + F.floor((F.col("rank") - F.col("r0")) / F.col("per"))).cast("long").alias("container_id"), "item_id", "piece_no", "token_start", "w")
    placed = placed.unionByName(pieces.where("w <= 0").select("kind", "cap", F.lit(0).cast("long").alias("container_id"), "item_id", "piece_no", "token_start", F.lit(0).cast("long").alias("w")))
    items = placed.select(F.col("kind").alias("container_kind"), F.col("cap").cast("int").alias("capacity_tokens"), "container_id", F.col("item_id").alias(item_id), "piece_no", "token_start", F.col("w").alias("n_tokens"))
    return items, spark.createDataFrame(report, REPORT)


REPORT = "container_kind string, capacity_tokens int, n_items long, n_tokens long, n_containers long, least_containers long, fixed_by_dominance long, unused_share double"
