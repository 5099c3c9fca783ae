"""Line retrieval: numbered lines, match with context, merged neighbours, ranks, token overlap.

Inputs are one row per text under key columns. Lines are the pieces between "\\n", without a final "\\r" and without one
empty piece after a last "\\n"; a null text has no lines and an empty one has none either. Every rank ends in the keys
and the line number, so results do not depend on order. Limits are the features' own (a report of the best hits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T


def latest(df: DataFrame, keys: list[str], order: list[str], unique: str | None = None) -> DataFrame:
    """The row of greatest ``order`` per key (nulls of ``order`` are least).

    With a ``unique`` column, also the last of ``order``, only narrow columns are aggregated and the rows come back by a
    semi-join on it, so unused wide columns are never read.
    """
    if unique is not None:
        greatest = F.max(F.struct(*[x for c in order for x in (F.col(c).isNotNull().alias(f"_{c}"), F.col(c).alias(c))]))
        return df.join(df.groupBy(*keys).agg(greatest.alias("_w")).select(F.col("_w")[unique].alias(unique)), unique, "left_semi")
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[x for c in order for x in (F.col(c).isNotNull(), F.col(c))]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys.., line_no (from 1), line."""
    parts = F.split(F.col(text), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    out = df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(parts).alias("_n", "_l"))
    return out.select(*keys, (F.col("_n") + 1).cast("long").alias("line_no"), F.regexp_replace("_l", r"\r$", "").alias("line"))


def with_context(ls: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``ls`` with ``before`` and ``after``: arrays of the n lines around each."""
    part = ", ".join(f"`{k}`" for k in keys)
    over = f"over (partition by {part} order by line_no rows between "
    if n <= 0:
        empty = F.array().cast("array<string>")
        return ls.withColumn("before", empty).withColumn("after", empty)
    return ls.withColumn("before", F.expr(f"collect_list(line) {over}{n} preceding and 1 preceding)")).withColumn("after", F.expr(f"collect_list(line) {over}1 following and {n} following)"))


def matches(ls: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Lines that match, with the first match's ``start`` and ``stop``."""
    span = T.line_span("line", query, regex, case_sensitive)
    return ls.withColumn("_s", span).where("_s is not null").select(*ls.columns, F.col("_s.start").alias("start"), F.col("_s.stop").alias("stop"))


def grep(df: DataFrame, keys: list[str], text: str, query: str, regex: bool = False, case_sensitive: bool = False, context: int = 2, limit: int | None = 50) -> DataFrame:
    """Ranked hits with context: whole words first, then shorter lines, then keys and line number.

    Texts without a hit are left out before any line is exploded; context comes from an equi-join on the
    neighbouring line numbers of the hits' texts only.
    """
    pre = df.where(T.contains_ci(text, query) if not regex and not case_sensitive else F.col(text).contains(query) if not regex else F.col(text).rlike(("(?m)" if case_sensitive else "(?im)") + query))
    hits = matches(with_context(lines(pre, keys, text), keys, context), query, regex, case_sensitive)
    hits = hits.withColumn("penalty", T.boundary_penalty("line", F.col("start"), F.col("stop")))
    out = hits.orderBy("penalty", F.length("line"), *keys, "line_no")
    return out.limit(limit) if limit is not None else out


def merged(hits: DataFrame, keys: list[str], context: int) -> DataFrame:
    """Hits of a text whose context touches, as one island: first_line, last_line, n_hits."""
    part = ", ".join(f"`{k}`" for k in keys)
    gap = F.expr(f"line_no - lag(line_no) over (partition by {part} order by line_no)")
    h = hits.select(*keys, "line_no").withColumn("_new", F.when(gap <= 2 * context, 0).otherwise(1))
    h = h.withColumn("_island", F.expr(f"sum(_new) over (partition by {part} order by line_no)"))
    return h.groupBy(*keys, "_island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_hits")).drop("_island")


def token_overlap(df: DataFrame, keys: list[str], text: str, tokens: list[str], path: str, min_tokens: int = 2, limit: int | None = 50) -> DataFrame:
    """Lines that contain at least ``min_tokens`` of the tokens, scored by how many, plus 1.5 for a declaration."""
    clean = [t.strip().lower() for t in tokens if t and t.strip()]
    ls = lines(df, keys, text).withColumn("_l", F.lower("line"))
    found = F.filter(F.array(*[F.when(F.col("_l").contains(t), t) for t in clean]), lambda x: x.isNotNull())
    ls = ls.withColumn("matched", found).where(F.size("matched") >= min_tokens)
    decl = F.ltrim("line").rlike(r"^(?:class |def |async def )")
    ls = ls.withColumn("score", F.size("matched").cast("double") + F.when(decl, 1.5).otherwise(0.0))
    late = F.when(F.col(path).startswith("tests/") | F.col(path).startswith("docs/"), 1).otherwise(0)
    out = ls.drop("_l").orderBy(F.desc("score"), late, *keys, "line_no")
    return out.limit(limit) if limit is not None else out


def outline(ls: DataFrame, keys: list[str]) -> DataFrame:
    """Markdown headings outside fences with their level and the nearest heading above of a lower level."""
    part = ", ".join(f"`{k}`" for k in keys)
    fence = F.when(F.ltrim("line").startswith("```"), 1).otherwise(0)
    x = ls.withColumn("_f", fence).withColumn("_open", F.expr(f"sum(_f) over (partition by {part} order by line_no)") % 2)
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)).cast("long")
    x = x.withColumn("level", level).where("level > 0 and _open = 0").withColumn("title", F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))
    above = [F.expr(f"last(case when level = {k} then struct(line_no, title) end, true) over (partition by {part} order by line_no rows between unbounded preceding and 1 preceding)") for k in range(1, 7)]
    for k, a in enumerate(above, 1):
        x = x.withColumn(f"_a{k}", a)
    options = F.array(*[F.when(F.col("level") > k, F.col(f"_a{k}")) for k in range(1, 7)])
    x = x.withColumn("_p", F.array_max(F.filter(options, lambda s: s.isNotNull())))
    return x.select(*keys, "line_no", "level", "title", F.col("_p.title").alias("parent"))


def relevant(chunks: DataFrame, keys: list[str], row_id: str, content: str, words: list[str], most: int = 3) -> DataFrame:
    """keys.., row_id, score, rank: of each file the chunks that hold most of the words (in any case), ties by id; chunks
    without any are left out, as are null contents."""
    low = F.lower(F.col(content))
    score = sum((F.when(low.contains(w.lower()), 1).otherwise(0) for w in dict.fromkeys(words)), F.lit(0))
    x = chunks.select(*keys, row_id, score.cast("long").alias("score")).where("score > 0")
    by = ", ".join(f"`{k}`" for k in keys)
    x = x.withColumn("rank", F.expr(f"row_number() over (partition by {by} order by score desc, `{row_id}`)").cast("long"))
    return x.where(F.col("rank") <= most)
