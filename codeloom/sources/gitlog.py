"""Exported version-control text as rows: logs, status, branches and blame.

A log is exported with the format below and ``--name-only``: a record separator, then hash, author, ISO date and message
between unit separators, then the names of the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: For ``git log --name-only --format=...``.
LOG_FORMAT = "%x1e%H%x1f%an%x1f%aI%x1f%B%x1f"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """hash, author, at, message, files of exported logs; records are split by the reader, so a log of any size spreads."""
    raw = spark.read.option("lineSep", "\x1e").text(path).where(F.trim("value") != "")
    p = F.split("value", "\x1f", -1)
    names = F.filter(F.transform(F.split(F.element_at(p, 5), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(F.trim(p[0]).alias("hash"), p[1].alias("author"), F.to_timestamp(p[2]).alias("at"), F.trim(p[3]).alias("message"), names.alias("files")).where("hash <> ''")


def status(lines: DataFrame) -> DataFrame:
    """path, index, worktree, old_path of ``git status --porcelain`` lines (column ``value``)."""
    name = F.substring("value", F.lit(4), F.length("value"))
    parts = F.split(name, " -> ")
    return lines.where(F.length("value") > 3).select(F.element_at(parts, -1).alias("path"), F.substring("value", 1, 1).alias("index"), F.substring("value", 2, 1).alias("worktree"), F.when(F.size(parts) > 1, parts[0]).alias("old_path"))


def branches(lines: DataFrame) -> DataFrame:
    """name, current of ``git branch`` lines."""
    return lines.where(F.trim("value") != "").select(F.trim(F.regexp_replace("value", r"^\*", "")).alias("name"), F.col("value").startswith("*").alias("current"))


def blame(lines: DataFrame, path: str) -> DataFrame:
    """path, line_no, hash of ``git blame --porcelain`` heads (hash, original line, final line)."""
    pat = r"^([0-9a-f]{40}) (\d+) (\d+)"
    return lines.where(F.col("value").rlike(pat)).select(F.col(path).alias("path"), F.regexp_extract("value", pat, 3).cast("long").alias("line_no"), F.regexp_extract("value", pat, 1).alias("hash"))


def diff_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., added, removed of unified diff lines."""
    v = F.col("value")
    return lines.groupBy(*keys).agg(F.count_if(v.startswith("+") & ~v.startswith("+++")).alias("added"), F.count_if(v.startswith("-") & ~v.startswith("---")).alias("removed"))
