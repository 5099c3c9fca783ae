"""Most similar vectors by cosine: shards around centres, a robust-pruned graph per shard, beam search.

Vectors become unit vectors; exact copies are one point with its members. Centres come from spherical k-means on a
bounded sample; every point goes to the shard of its nearest centre and of those nearly as near (``margin``). Each
shard's graph (see ``vamana``) is built in one task; a shard with more than ``max_points`` points is split by hash of
the id, and its points then also search the other splits. ``near_pairs`` takes the points within the threshold that a
beam search from every point meets, the beam widening as long as such points fill it, so there is no cap on partners.
``links`` gives classes of copies and numbers of partners without spelling out pairs. ``neighbours`` searches the
``probes`` nearest shards of each query and merges.

Loss of accuracy. ``recall`` measures it against brute force over all rows; see the README for figures.

Defined results
- Rows with a null id, and vectors that are null, not of ``dim`` values, all zero, or hold a null, NaN or infinity, take
  no part. Scaled vectors are the same direction.
- Copies are neighbours of one another with similarity 1. Ties are ordered by id. Repeated ids count once per vector.
- Fewer than k other rows give fewer neighbours; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.vamana import NONE, Graph, centroids
from codeloom.session import Scratch, bounded_broadcast

#: Points that centres are fitted on: eight for each centre, at least and at most so many.
SAMPLE, MOST_SAMPLE = 20_000, 200_000
SHARD = 4_000
DEGREE, BEAM, ALPHA = 24, 32, 1.1
#: Members of a class of copies that meet in one task.
BLOCK = 1_000


def units(df: DataFrame, row_id: str, vector: str, dim: int) -> DataFrame:
    """(id, v): unit vectors as bytes of float32, of the rows that have one."""

    @F.arrow_udf("binary")
    def unit(v: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(v), dim), False)
        x = v.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        ok = (size > 0) & np.isfinite(size)
        raw = (x / np.where(ok, size, 1)[:, None]).astype(np.float32).tobytes()
        out: list[bytes | None] = [None] * len(v)
        for i, (at, good) in enumerate(zip(np.flatnonzero(fits.to_numpy(zero_copy_only=False)), ok)):
            if good:
                out[at] = raw[4 * dim * i : 4 * dim * (i + 1)]
        return pa.array(out, pa.binary())

    return df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("x")).where("id is not null").select("id", unit("x").alias("v")).where("v is not null")


def matrix(v, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in v), dtype=np.float32).reshape(-1, dim)


class Shards:
    """Centres, and the shards of vectors."""

    def __init__(self, centres: np.ndarray, margin: float, most: int):
        self.c, self.margin, self.most = centres, margin, most

    def of(self, x: np.ndarray) -> list[list[int]]:
        """Shards a point is kept in: its nearest, and those within the margin."""
        out: list[list[int]] = []
        m = min(self.most, len(self.c))
        for at in range(0, len(x), 4096):
            s = x[at : at + 4096] @ self.c.T
            top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(self.c) else np.tile(np.arange(m), (len(s), 1))
            d = np.take_along_axis(s, top, 1)
            ok = d >= d.max(1, keepdims=True) - self.margin
            out += [t[k].tolist() for t, k in zip(top, ok)]
        return out

    def probes(self, x: np.ndarray, n: int) -> list[list[int]]:
        """The n nearest shards."""
        n = min(n, len(self.c))
        s = x @ self.c.T
        return (np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(self.c) else np.tile(np.arange(n), (len(s), 1))).tolist()


def fit_shards(points: DataFrame, n: int, dim: int, shard: int, sample: int, margin: float, most: int = 4, seed: int = 5) -> Shards:
    """Centres from a sample of points, one per ``shard`` points, as far as a sample of MOST_SAMPLE allows (25000 centres)."""
    sample = min(max(sample, 8 * -(-n // shard)), MOST_SAMPLE)
    share = min(1.0, 1.2 * sample / max(1, n))
    some = points.where(F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1_000_000)) < int(1_000_000 * share) + 1).limit(sample).collect()
    k = max(1, min(-(-n // shard), len(some) // 8))
    x = matrix([r["v"] for r in sorted(some, key=lambda r: r["id"])], dim)
    return Shards(centroids(x, k) if k > 1 else np.zeros((1, dim), dtype=np.float32), margin, most)


def _placed(points: DataFrame, shards: Shards, dim: int, probes: int | None = None) -> DataFrame:
    """(shard, id, v): points in the shards they are kept in, or queries in those they search."""

    @F.pandas_udf("array<int>")
    def place(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype="object")
        x = matrix(s, dim)
        return pd.Series(shards.of(x) if probes is None else shards.probes(x, probes))

    return points.select("id", "v", F.explode(place("v")).alias("shard"))


def _split(kept: DataFrame, max_points: int) -> DataFrame:
    """(shard, parts): how many parts each shard needs; a row per shard."""
    return kept.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.ceil(F.col("n") / max_points).cast("int").alias("parts"))


def _cells(kept: DataFrame, asking: DataFrame | None, parts: DataFrame) -> DataFrame:
    """(shard, part, id, v, role): index points each in one part; queries in every part of their shard."""
    p = bounded_broadcast(parts, 50_000)
    ix = kept.join(p, "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v", F.lit(0).alias("role"))
    if asking is None:
        other = kept.join(p.where("parts > 1"), "shard").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        q = other.select("shard", F.explode(F.expr("filter(sequence(0, parts - 1), x -> x < own)")).alias("part"), "id", "v", F.lit(1).alias("role"))
    else:
        q = asking.join(p, "shard").select("shard", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "id", "v", F.lit(1).alias("role"))
    return ix.unionByName(q)


def _graphs(cells: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` (ids, vectors and roles of a cell to frames) over every cell, cell by cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = None, []
        for pdf in batches:
            keys = pdf["shard"].to_numpy() * np.int64(1 << 31) + pdf["part"].to_numpy()
            for i, j in _runs(keys):
                if keys[i] != now:
                    if parts:
                        yield from fn(pd.concat(parts))
                    now, parts = keys[i], []
                parts.append(pdf.iloc[i:j][["id", "v", "role"]])
        if parts:
            yield from fn(pd.concat(parts))

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "shard", "part").sortWithinPartitions("shard", "part").mapInPandas(run, schema)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    yield from zip(at, [*at[1:], len(keys)])


def class_pairs(df: DataFrame, row_id: str, vector: str, near: float, scratch: Scratch, dim: int = 64, shard: int = SHARD, sample: int = SAMPLE, margin: float = 0.06, max_points: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """((a, b, s): pairs a < b of classes of copies at least ``near`` similar; (rep, id, n): the members of each class,
    which is named by its least id, and their number)."""
    u = scratch.write(units(df, row_id, vector, dim).distinct())
    classes = scratch.write(u.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    n = classes.count()
    members = u.join(classes.select("v", F.col("id").alias("rep"), "n").where("n > 1"), "v").select("rep", "id", "n")
    members = scratch.write(members.unionByName(classes.where("n = 1").select(F.col("id").alias("rep"), "id", "n")))
    if not n:
        return df.sparkSession.createDataFrame([], "a long, b long, s double"), members
    shards = fit_shards(classes.select("id", "v"), n, dim, shard, sample, margin)
    kept = _placed(classes.select("id", "v"), shards, dim)
    cells = _cells(kept, None, scratch.write(_split(kept, max_points)))

    def found(cell: pd.DataFrame) -> Iterator[pd.DataFrame]:
        cell = cell.sort_values(["role", "id"])
        ids, x = cell["id"].to_numpy(), matrix(cell["v"], dim)
        own = ids[: int((cell["role"] == 0).sum())]
        if len(own):
            start = np.where(np.arange(len(ids)) < len(own), np.arange(len(ids)), NONE)
            for i, j, s in Graph(x[: len(own)], DEGREE, BEAM, ALPHA).build().within(x, near, BEAM, start):
                a, b = ids[i], own[j]
                ok = a != b
                yield pd.DataFrame({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok], "s": s[ok].astype("float64")})

    return _graphs(cells, found, "a long, b long, s double").groupBy("a", "b").agg(F.max("s").alias("s")), members


def near_pairs(df: DataFrame, row_id: str, vector: str, near: float, **options) -> DataFrame:
    """(id_a, id_b, similarity) with id_a < id_b of all rows found at least ``near`` similar, copies included: the pairs of
    classes spelled out. Large classes meet in blocks of their members, so that none lies in one task."""
    pairs, members = class_pairs(df, row_id, vector, near, Scratch(df.sparkSession), **options)
    many = members.where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sizes = many.select("rep", "blocks").distinct()
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    for c in ("a", "b"):
        pairs = pairs.join(sizes.withColumnRenamed("rep", c), c, "left").withColumn("block", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)"))).drop("blocks")
        pairs = pairs.join(many.select(F.col("rep").alias(c), F.col("id").alias(f"i{c}"), "block"), [c, "block"], "left").withColumn(f"i{c}", F.coalesce(f"i{c}", c)).drop("block")
    one = many.select("rep", F.col("id").alias("ia"), F.col("block").alias("p"), every.alias("q"))
    two = many.select("rep", F.col("id").alias("ib"), every.alias("p"), F.col("block").alias("q"))
    same = one.join(two, ["rep", "p", "q"]).where("ia < ib").select("ia", "ib", F.lit(1.0).alias("s"))
    out = pairs.select("ia", "ib", "s").unionByName(same).where("ia <> ib")
    return out.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), F.round("s", 6).alias("similarity"))


def links(df: DataFrame, row_id: str, vector: str, near: float, **options) -> DataFrame:
    """(id, class_id, class_size, n_links): every row that has a vector with its class of copies and the number of other
    rows found at least ``near`` similar, without spelling out the pairs."""
    scratch = Scratch(df.sparkSession)
    pairs, members = class_pairs(df, row_id, vector, near, scratch, **options)
    pairs = scratch.write(pairs)
    size = members.select("rep", "n").distinct()
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    far = both.join(size.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("n").alias("far"))
    count = size.join(far, "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return members.join(count, "rep").select("id", F.col("rep").alias("class_id"), F.col("n").alias("class_size"), "n_links")


def _found(u: DataFrame, queries: DataFrame, k: int, dim: int, shard: int, sample: int, margin: float, max_points: int, probes: int, beam: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((q, rep, s): the best k points of every query and shard part; (id, v, n): the points)."""
    classes = scratch.write(u.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    n = classes.count()
    if not n:
        return u.select(F.col("id").alias("q"), F.col("id").alias("rep"), F.lit(0.0).alias("s")).limit(0), classes
    shards = fit_shards(classes.select("id", "v"), n, dim, shard, sample, margin)
    kept = _placed(classes.select("id", "v"), shards, dim)
    parts = scratch.write(_split(kept, max_points))
    cells = _cells(kept, _placed(queries.select("id", "v"), shards, dim, probes), parts)

    def found(cell: pd.DataFrame) -> Iterator[pd.DataFrame]:
        cell = cell.sort_values(["role", "id"])
        ids, x = cell["id"].to_numpy(), matrix(cell["v"], dim)
        m = int((cell["role"] == 0).sum())
        if not 0 < m < len(ids):
            return
        g = Graph(x[:m], DEGREE, BEAM, ALPHA).build()
        for at in range(m, len(ids), g.batch):
            part = slice(at, at + g.batch)
            i, s = g.search(x[part], min(max(beam, 2 * k), g.n))
            top = np.argsort(-np.where(i == NONE, -3, s), axis=1, kind="stable")[:, : k + 1]
            i, s = np.take_along_axis(i, top, 1), np.take_along_axis(s, top, 1)
            r, c = np.nonzero(i != NONE)
            yield pd.DataFrame({"q": ids[part][r], "rep": ids[i[r, c]], "s": s[r, c].astype("float64")})

    return _graphs(cells, found, "q long, rep long, s double").groupBy("q", "rep").agg(F.max("s").alias("s")), classes


def neighbours(df: DataFrame, row_id: str, vector: str, k: int, queries: str, dim: int = 64, shard: int = SHARD, sample: int = SAMPLE, margin: float = 0.06, max_points: int = 20_000, probes: int = 8, beam: int = 64) -> DataFrame:
    """(id, rank, neighbour, similarity): the k most similar rows of each row that ``queries`` (SQL on id) selects."""
    scratch = Scratch(df.sparkSession)
    u = scratch.write(units(df, row_id, vector, dim).distinct())
    hits, classes = _found(u, u.where(queries), k, dim, shard, sample, margin, max_points, probes, beam, scratch)
    best = hits.withColumn("r", F.expr("row_number() over (partition by q order by s desc, rep)")).where(F.col("r") <= k + 1)
    # of a class of copies at most k + 1 members can be among the first k; taken in two steps, by bucket first
    many = classes.where("n > 1").select("v", F.col("id").alias("rep")).join(u, "v").select("rep", "id", F.pmod(F.xxhash64("id"), F.lit(256)).alias("bucket"))
    many = many.withColumn("r", F.expr("row_number() over (partition by rep, bucket order by id)")).where(F.col("r") <= k + 1)
    many = many.withColumn("r", F.expr("row_number() over (partition by rep order by id)")).where(F.col("r") <= k + 1).select("rep", "id")
    out = best.select("q", "rep", "s").join(many, "rep", "left").select("q", F.coalesce("id", "rep").alias("nb"), F.round("s", 6).alias("s")).where("nb <> q")
    out = out.withColumn("rank", F.expr("row_number() over (partition by q order by s desc, nb)")).where(F.col("rank") <= k)
    return out.select(F.col("q").alias("id"), F.col("rank").cast("long").alias("rank"), F.col("nb").alias("neighbour"), F.col("s").alias("similarity"))


def brute_force(points: DataFrame, queries: list[tuple[int, bytes]], k: int, dim: int) -> DataFrame:
    """(q, rep, s): exact best k points of a block of queries, from the best k of each partition."""
    qid = np.array([q for q, _ in queries], dtype="int64")
    qx = matrix([v for _, v in queries], dim) if queries else np.zeros((0, dim), dtype=np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.zeros((len(qid), 0), dtype="int64")
        sims = np.zeros((len(qid), 0), dtype=np.float32)
        for pdf in batches:
            if not len(pdf) or not len(qid):
                continue
            x, at = matrix(pdf["v"], dim), pdf["id"].to_numpy()
            for i in range(0, len(x), 512):  # a slice of similarities stays small whatever the number of queries
                s = qx @ x[i : i + 512].T
                m = min(k, s.shape[1])
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                ids = np.concatenate([ids, at[i : i + 512][top]], 1)
                sims = np.concatenate([sims, np.take_along_axis(s, top, 1)], 1)
                if sims.shape[1] > k:
                    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        if sims.shape[1]:
            yield pd.DataFrame({"q": np.repeat(qid, sims.shape[1]), "rep": ids.ravel(), "s": sims.ravel().astype("float64")})

    return points.select("id", "v").mapInPandas(run, "q long, rep long, s double")


def recall(df: DataFrame, row_id: str, vector: str, k: int, queries: str, dim: int = 64, block: int = 20_000, **options) -> DataFrame:
    """(n_queries, k, recall): the share of the k most similar vectors other than its own that the search finds, over
    all queries, against brute force over all rows in blocks of at most ``block`` queries."""
    scratch = Scratch(df.sparkSession)
    u = scratch.write(units(df, row_id, vector, dim).distinct())
    asks = u.where(queries)
    o = {"shard": SHARD, "sample": SAMPLE, "margin": 0.06, "max_points": 20_000, "probes": 8, "beam": 64} | options
    hits, classes = _found(u, asks, k, dim, o["shard"], o["sample"], o["margin"], o["max_points"], o["probes"], o["beam"], scratch)
    own = scratch.write(asks.withColumnRenamed("id", "q").join(classes.select("v", F.col("id").alias("rep")), "v").select("q", "rep"))

    def others(df: DataFrame) -> DataFrame:
        """The best k of each query without its own vector; at least k + 1 come in."""
        df = df.join(own, ["q", "rep"], "left_anti")
        return df.withColumn("r", F.expr("row_number() over (partition by q order by s desc, rep)")).where(F.col("r") <= k)

    hits = scratch.write(others(hits))
    n = asks.count()
    blocks = max(1, -(-n // block))
    truth = None
    for i in range(blocks):
        rows = [(r["id"], bytes(r["v"])) for r in asks.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()]
        part = brute_force(classes, rows, k + 1, dim)
        part = scratch.write(others(part).groupBy("q").agg(F.min("s").alias("least"), F.count("*").alias("n")))
        truth = part if truth is None else truth.unionByName(part)
    got = truth.join(hits.select("q", "s"), "q", "left").groupBy("q").agg(F.max("n").alias("n"), F.count_if(F.col("s") >= F.col("least") - 1e-6).alias("hit"))
    return got.agg(F.count("*").alias("n_queries"), F.lit(k).cast("long").alias("k"), F.round(F.sum("hit") / F.sum("n"), 4).alias("recall"))
