"""Directories and projects: roll-ups along the tree, listings, totals and top extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T


def prefixes(path: str | Column) -> Column:
    """All directories above a path, "" first."""
    p = F.split(F.col(path) if isinstance(path, str) else path, "/")
    n = F.size(p)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(p, F.lit(1), k), "/"))


def rollup(files: DataFrame, keys: list[str], path: str, size: str, lines: str | None = None, max_depth: int | None = None) -> DataFrame:
    """keys.., dir, depth, files, bytes(, lines), truncated: totals of every directory down to ``max_depth``; one at that
    depth reports zeros and truncated."""
    cols = [F.col(size).alias("_s"), *([F.col(lines).alias("_l")] if lines else [])]
    x = files.select(*keys, *cols, F.explode(prefixes(path)).alias("dir"))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))).cast("long")
    g = x.groupBy(*keys, "dir").agg(F.count("*").alias("files"), F.sum("_s").alias("bytes"), *([F.sum("_l").alias("lines")] if lines else [])).withColumn("depth", depth)
    if max_depth is None:
        return g.withColumn("truncated", F.lit(False))
    cut = F.col("depth") == max_depth
    g = g.where(F.col("depth") <= max_depth).withColumn("truncated", cut)
    for c in ("files", "bytes", *(["lines"] if lines else [])):
        g = g.withColumn(c, F.when(cut, F.lit(0).cast("long")).otherwise(F.col(c)))
    return g


def tree(files: DataFrame, keys: list[str], path: str, max_depth: int = 2, hidden: bool = False) -> DataFrame:
    """keys.., entry, kind, depth: files and directories down to a depth; names that start with a dot only if asked for."""
    d = files.select(*keys, F.explode(prefixes(path)).alias("entry")).where("entry <> ''").select(*keys, "entry", F.lit("dir").alias("kind"))
    both = d.unionByName(files.select(*keys, F.col(path).alias("entry"), F.lit("file").alias("kind"))).distinct()
    both = both.withColumn("depth", F.size(F.split("entry", "/")).cast("long")).where(F.col("depth") <= max_depth)
    return both if hidden else both.where(~F.col("entry").rlike(r"(?:^|/)\.[^/]"))


def extensions(files: DataFrame, keys: list[str], path: str, size: str, top: int = 10) -> DataFrame:
    """keys.., extension, files, bytes: the commonest extensions of each project."""
    g = files.groupBy(*keys, T.suffix(path).alias("extension")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    part = ", ".join(f"`{k}`" for k in keys)
    return g.withColumn("_n", F.expr(f"row_number() over (partition by {part} order by files desc, extension)")).where(F.col("_n") <= top).drop("_n")
