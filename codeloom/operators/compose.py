"""Contexts: sections of ranked texts under one token budget, lookups by token, hashed embeddings, diffs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T


def context(sections: dict[str, DataFrame], budget: int) -> DataFrame:
    """(section, rank, text, tokens, used): rows of each section (rank, text) in the order of the sections, as long as the
    running number of tokens stays within the budget. Sections are short reports."""
    parts = [df.select(F.lit(i).alias("_o"), F.lit(name).alias("section"), F.col("rank").cast("long").alias("rank"), "text") for i, (name, df) in enumerate(sections.items())]
    x = reduce(DataFrame.unionByName, parts).withColumn("tokens", T.token_estimate("text"))
    return x.withColumn("used", F.expr("sum(tokens) over (order by _o, rank)")).where(F.col("used") <= budget).drop("_o")


def numbered(df: DataFrame, text: Column, order: list[Column | str], limit: int) -> DataFrame:
    """(rank, text) of the first rows of a report."""
    top = df.withColumn("_t", text).orderBy(*order).limit(limit)
    by = F.row_number()
    from pyspark.sql import Window

    return top.withColumn("rank", by.over(Window.orderBy(*order))).select("rank", F.col("_t").alias("text"))


def authenticated(tokens: DataFrame, users: DataFrame, token_hash: str, as_of: str) -> DataFrame:
    """(username, role, label): the user of a token that has not expired at ``as_of`` (a token without an end never does)."""
    now = F.lit(as_of).cast("timestamp")
    live = tokens.where((F.col("token_hash") == token_hash) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return live.join(users, "username").select("username", "role", "label")


def hashed_embedding(text: str | Column, dim: int = 64) -> Column:
    """Counts of words by hash as a unit vector: the stand-in where no embedding model is plugged in; null without words."""
    slots = F.transform(T.query_words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(slots, lambda s: s == d)).cast("double"))
    return F.transform(T.unit_vector(counts), lambda x: x.cast("float"))


def unified_diff(old: Column, new: Column, path: Column) -> Column:
    """struct(diff, added, removed) of two texts."""

    @F.pandas_udf("struct<diff:string,added:long,removed:long>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from difflib import unified_diff as lib

        for a, b, p in batches:
            rows = []
            for x, y, name in zip(a, b, p):
                d = list(lib((x or "").splitlines(), (y or "").splitlines(), f"a/{name}", f"b/{name}", lineterm=""))
                rows.append(("\n".join(d), sum(1 for s in d[2:] if s.startswith("+")), sum(1 for s in d[2:] if s.startswith("-"))))
            yield pd.DataFrame(rows, columns=["diff", "added", "removed"])

    return run(old, new, path)
