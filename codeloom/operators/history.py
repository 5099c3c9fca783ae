"""Commit history: parsed logs and blame, classification, issue references, co-change and risk.

Commits are rows (hash, author, at, message, files array). Ages are taken from an explicit ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of defensive and of hardening commits.
DEFENSIVE = ["fix", "bugfix", "bug fix", "hotfix", "patch", "workaround", "edge case", "edge-case", "regression", "rollback", "revert", "guard against", "defensive", "race condition", "deadlock", "memory leak", "null check", "off-by-one", "off by one", "crash", "panic", "segfault", "cve", "security", "vulnerability", "issue", "closes #", "fixes #"]
HARDENING = ["harden", "protect", "sanitize", "validate", "escape", "throttle", "rate limit", "fallback", "backoff", "retry", "timeout"]
#: Issue references as (kind, pattern, prefix of the identifier).
ISSUES = [
    ("github_pr", r"(?i)\b(?:PR|pull request)\s*[#-]?(\d{1,7})\b", "PR-"),
    ("github", r"(?:^|[^\w])#(\d{1,7})\b", "#"),
    ("github_alt", r"\bGH-(\d{1,7})\b", "GH-"),
    ("gitlab_mr", r"(?:^|[^\w])!(\d{1,7})\b", "!"),
    ("ado", r"\bAB#(\d{1,7})\b", "AB#"),
    ("jira", r"\b((?!(?:PR|GH|AB|MR|CI|CD)-)[A-Z][A-Z0-9]{1,9}-\d{1,7})\b", ""),
]
CLOSING = r"(?i)(?:close[sd]?|fix(?:es|ed)?|resolve[sd]?)"
TAG = r"(?:#|GH-|[A-Z]{2,}-)(\d+)"


def has_any(message: str | Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))


def classified(commits: DataFrame, message: str = "message") -> DataFrame:
    """``commits`` with is_defensive and is_hardening."""
    return commits.withColumn("is_defensive", has_any(message, DEFENSIVE)).withColumn("is_hardening", has_any(message, HARDENING))


def issue_tags(message: str | Column) -> Column:
    """Distinct tags in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(message, F.lit(TAG), 0))


def issues(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys.., kind, identifier, number, closing: one row per kind and identifier; closing if a closing verb stands within
    the 24 characters before its first mention."""
    out = None
    for kind, pattern, prefix in ISSUES:
        found = df.select(*keys, F.col(text).alias("_t"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))).alias("_n"))
        ident = F.concat(F.lit(prefix), F.when(F.lit(kind == "jira"), F.col("_n")).otherwise(F.col("_n").cast("long").cast("string")))
        number = F.regexp_extract("_n", r"(\d+)$", 1).cast("long")
        at = F.regexp_instr(F.col("_t"), _one(kind, F.col("_n")))
        before = F.substring(F.col("_t"), F.greatest(at - 24, F.lit(1)), F.least(at - 1, F.lit(24)))
        part = found.select(*keys, F.lit(kind).alias("kind"), ident.alias("identifier"), number.alias("number"), F.coalesce(before.rlike(CLOSING), F.lit(False)).alias("closing"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys, "kind", "identifier").agg(F.min("number").alias("number"), F.bool_or("closing").alias("closing"))


def _one(kind: str, number: Column) -> Column:
    """The pattern of one reference, without the character before it."""
    head, tail = {"github_pr": (r"(?i)\b(?:PR|pull request)\s*[#-]?", r"\b"), "github": (r"(?<!\w)#", r"\b"), "github_alt": (r"\bGH-", r"\b"), "gitlab_mr": (r"(?<!\w)!", r"\b"), "ado": (r"\bAB#", r"\b"), "jira": (r"\b", r"\b")}[kind]
    return F.concat(F.lit(head), number, F.lit(tail))


def cochange(commits: DataFrame, file: str, top: int | None = 10, files: str = "files") -> DataFrame:
    """(file, other, n): how many commits change both the file and another, the most frequent first.

    The companions of a commit come from its own array of files, so no join on a hot commit is needed.
    """
    c = commits.select(F.array_distinct(files).alias("fs")).where(F.array_contains("fs", file))
    n = c.select(F.lit(file).alias("file"), F.explode("fs").alias("other")).where("other <> file").groupBy("file", "other").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "file", "other").limit(top) if top is not None else n


def file_history(commits: DataFrame, as_of: str, files: str = "files") -> DataFrame:
    """Per file: commits, authors, first and last commit, days active, defensive and hardening counts, risk and level.

    Risk is 0.30 defensive share + 0.20 hardening share + 0.20 min(1, commits / 50) + 0.15 min(1, authors / 10) +
    0.15 exp(-age in days / 90).
    """
    c = classified(commits).select(F.explode(F.array_distinct(files)).alias("file"), "author", "at", "is_defensive", "is_hardening")
    g = c.groupBy("file").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_if("is_defensive").alias("defensive"), F.count_if("is_hardening").alias("hardening"))
    days = F.greatest(F.lit(0), F.floor((F.unix_timestamp("last_at") - F.unix_timestamp("first_at")) / 86400))
    age = F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_at")) / 86400))
    n = F.col("commits")
    score = 0.30 * F.col("defensive") / n + 0.20 * F.col("hardening") / n + 0.20 * F.least(F.lit(1.0), n / 50.0) + 0.15 * F.least(F.lit(1.0), F.col("authors") / 10.0) + 0.15 * F.exp(-age / 90.0)
    g = g.withColumn("days_active", days.cast("long")).withColumn("risk", F.round(score, 4))
    return g.withColumn("level", F.when(F.col("risk") >= 0.6, "high").when(F.col("risk") >= 0.3, "medium").otherwise("low"))


def dominant(blame: DataFrame, path: str, line_no: str, commit: str, start: int, stop: int) -> DataFrame:
    """(path, commit, n_lines): the commit of most lines of a range of each file; ties go to the lesser hash."""
    n = blame.where(F.col(line_no).between(start, stop)).groupBy(path, commit).agg(F.count("*").alias("n_lines"))
    return n.groupBy(path).agg(F.min(F.struct((-F.col("n_lines")).alias("m"), F.col(commit).alias("c"))).alias("b")).select(path, F.col("b.c").alias(commit), (-F.col("b.m")).alias("n_lines"))
