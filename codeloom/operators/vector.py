"""Vector and keyword search, reciprocal rank fusion, boosts and reranking.

Vectors compare by cosine; rows whose vector is null, zero or of another length than the query's take no part. Filters
come before the limit. Scores are rounded to six digits and ties are ordered by id, so results are stable.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine of vectors with the query by one matrix product per Arrow batch; null for those that are null, zero or of
    another length, NaN for those that hold a null or NaN."""
    q = np.asarray(query, dtype="float64")

    @F.arrow_udf("double")
    def scored(v: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(v), len(q)), False)
        x = v.filter(fits).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, len(q))
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        out = np.full(len(v), np.nan)
        none = np.ones(len(v), dtype=bool)
        at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
        out[at], none[at] = x @ q / np.where(size > 0, size, 1) / np.sqrt(q @ q), size == 0
        return pa.array(out, pa.float64(), mask=none)

    return scored(vector)


def topk(df: DataFrame, row_id: str, vector: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """``df``'s k best rows with ``score``. The query is a literal, so no join is needed."""
    n = sum(x * x for x in query) ** 0.5
    if not n:
        return df.limit(0).withColumn("score", F.lit(0.0))
    rows = df if where is None else df.where(where)
    rows = rows.where(F.size(vector) == len(query)).withColumn("score", F.round(cosine(F.col(vector), query), 6))
    return rows.where("score is not null and not isnan(score)").orderBy(F.desc("score"), row_id).limit(k)


def keyword(df: DataFrame, row_id: str, text: str, query: str, k: int) -> DataFrame:
    """The first k rows that contain the query, by id, each with score 1."""
    return df.where(T.contains_ci(text, query)).withColumn("score", F.lit(1.0)).orderBy(row_id).limit(k)


def rrf(lists: dict[str, DataFrame], row_id: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (each with ``score``): row_id, score, found_in."""
    both = None
    for name, df in lists.items():
        part = df.select(F.col(row_id), F.lit(name).alias("list"), F.expr(f"row_number() over (order by score desc, `{row_id}`)").alias("rank"))  # lists are top-k reports
        both = part if both is None else both.unionByName(part)
    fused = both.groupBy(row_id).agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score"), F.sort_array(F.collect_set("list")).alias("found_in"))
    return fused.orderBy(F.desc("score"), row_id)


def boosted(first: DataFrame, then: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Rows of ``first``, then those of ``then`` whose keys are not among them; each keeps its list's order (score)."""
    cols = [*keys, "score"]
    rest = then.select(*cols).join(first.select(*keys), keys, "left_anti")
    both = first.select(*cols, F.lit(0).alias("_p")).unionByName(rest.select(*cols, F.lit(1).alias("_p")))
    return both.withColumn("source", F.when(F.col("_p") == 0, "boost").otherwise("vector")).orderBy("_p", F.desc("score"), *keys).limit(limit).drop("_p")


def rerank(rows: DataFrame, model: Callable[[Column], Column] | None = None, text: str = "content", chars: int = 1000) -> DataFrame:
    """Rows by the model's score of their first characters; without a model they stay as they are."""
    if model is None:
        return rows.withColumn("rerank_score", F.col("score"))
    return rows.withColumn("rerank_score", model(F.substring(text, 1, chars))).orderBy(F.desc("rerank_score"))


#: Words that say nothing in a search for code.
STOPWORDS = ["about", "after", "before", "code", "does", "file", "find", "from", "function", "handle", "handles", "into", "show", "that", "the", "this", "where", "with"]


def query_tokens(query: str) -> list[str]:
    """Distinct lower-case identifiers of at least three characters that are no stop words, in order."""
    import re

    return list(dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_]{2,}", query) if w.lower() not in STOPWORDS))


def variants(token: str) -> list[str]:
    """A token and its singulars."""
    out = [token]
    for end, least, put in (("ies", 5, "y"), ("es", 5, ""), ("s", 4, "")):
        if token.endswith(end) and len(token) >= least:
            out.append(token[: -len(end)] + put)
    return sorted(set(out))


def lexical_boost(ls: DataFrame, path: str, query: str, limit: int, keep: float = 5.0) -> DataFrame:
    """Files by overlap of path and best line with the query's tokens: path, line_no, line, matched, score, relevance.

    Per token: 3 in the path, 2 more in the base name, 2 in a line; a declaration adds 1.5 and two or more tokens of
    a line their number. The file's score is path, best line and number of tokens, plus 4 for all tokens or 2 for
    three; tests count 0.55. Built and copied files are left out.
    """
    tokens = query_tokens(query)
    if len(tokens) < 2:
        return ls.limit(0).select(path, "line_no", "line", F.lit(0).cast("long").alias("matched"), F.lit(0.0).alias("score"), F.lit(0.0).alias("relevance"))

    def hit(text: Column, token: str) -> Column:
        out = F.lit(False)
        for v in variants(token):
            out = out | text.contains(v)
        return out

    low, line = F.lower(F.col(path)), F.lower(F.col("line"))
    rows = ls.where(~T.is_built_path(path))
    on_line = F.filter(F.array(*[F.when(hit(line, t), t) for t in tokens]), lambda x: x.isNotNull())
    rows = rows.withColumn("_m", on_line).where(F.size("_m") > 0)
    n = F.size("_m").cast("double")
    decl = F.ltrim("line").rlike(r"^(?:class |def |async def )")
    rows = rows.withColumn("_s", 2 * n + F.when(decl, 1.5).otherwise(0.0) + F.when(n >= 2, n).otherwise(0.0))
    best = rows.groupBy(path).agg(F.max_by(F.struct("line_no", "line", "_m", "_s"), F.struct("_s", -F.col("line_no"))).alias("b"))
    in_path = F.filter(F.array(*[F.when(hit(low, t), t) for t in tokens]), lambda x: x.isNotNull())
    in_name = F.filter(F.array(*[F.when(hit(T.basename(low), t), t) for t in tokens]), lambda x: x.isNotNull())
    best = best.withColumn("_all", F.array_union(in_path, F.col("b._m"))).where(F.size("_all") >= 2)
    m = F.size("_all")
    score = 3.0 * F.size(in_path) + 2.0 * F.size(in_name) + F.col("b._s") + m + F.when(m == len(tokens), 4.0).when(m >= 3, 2.0).otherwise(0.0)
    score = score * F.when(low.startswith("tests/") | low.contains("/tests/"), 0.55).otherwise(1.0)
    best = best.withColumn("score", F.round(score, 6)).where(F.col("score") >= keep)
    out = best.select(path, F.col("b.line_no").alias("line_no"), F.trim("b.line").alias("line"), m.cast("long").alias("matched"), "score", F.round(F.least(F.lit(0.98), 0.55 + F.col("score") / 40), 6).alias("relevance"))
    return out.orderBy(F.desc("relevance"), F.desc("score"), path).limit(limit)
