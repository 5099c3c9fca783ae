"""Flag source files that do not parse in their language, with the line of the first error.

Each language has a grammar in the package, turned into LR tables once per Python worker; a lexer by one pattern
gives token classes, and a generalised LR recogniser reads the whole token stream with the language's layout and
inserted semicolons (see ``codeloom.llm.syntax``). Files meet their language by a join on workspace and path.

Defined results
- Languages: python (3.12), javascript (a CommonJS script), typescript (a module), java, go, c, json (strict), yaml and
  toml, in any spelling. Files of other or unknown languages, without a language, or of null content are not judged:
  their ``valid`` is null.
- An empty python, javascript, typescript, c, yaml or toml file is valid; an empty json, java or go file follows its
  grammar (json and go need something, java does not).
- Repeated index rows count once; where they differ in language beyond spelling, the first by name holds.
- Only syntax counts: names, types and early errors beyond the grammar do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.syntax.languages import NAMES, TEXTS, first_error


def canonical(language: Column) -> Column:
    """Language behind a spelling, JVM-side."""
    name = F.regexp_replace(F.lower(F.trim(language)), r"^\.+", "")
    pairs = [F.lit(x) for kv in sorted(NAMES.items()) for x in kv]
    return F.coalesce(F.create_map(*pairs)[name], name)


def error_line(language: Column, content: Column) -> Column:
    """The 1-based line of the first error, or null."""

    @F.pandas_udf("long")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lang, text in batches:
            yield pd.Series([first_error(a, b) for a, b in zip(lang, text)], dtype="Int64")

    return judged(language, content)


def checked(pushed: DataFrame, index: DataFrame, ids: list[str], keys: list[str], content: str = "content", language: str = "language") -> DataFrame:
    """ids.., keys.., language, valid, error_line of every pushed row."""
    known = index.select(*[F.col(k).alias(f"_{k}") for k in keys], canonical(F.col(language)).alias("_language")).where(F.col("_language").isNotNull())
    known = known.groupBy(*[f"_{k}" for k in keys]).agg(F.min("_language").alias("_language"))
    rows = pushed.select(*ids, *[k for k in keys if k not in ids], F.col(content).alias("_content"))
    on = [rows[k] == known[f"_{k}"] for k in keys]
    both = rows.join(known, on, "left").withColumn("error_line", error_line(F.col("_language"), F.col("_content")))
    judged = F.col("_language").isin(sorted(TEXTS)) & F.col("_content").isNotNull()
    return both.select(*ids, *[k for k in keys if k not in ids], F.col("_language").alias("language"), F.when(judged, F.col("error_line").isNull()).alias("valid"), "error_line")


def rates(rows: DataFrame, group: str) -> DataFrame:
    """group, language, n_files, n_invalid, invalid_rate over the judged rows."""
    out = rows.where("valid is not null").groupBy(group, "language").agg(F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"))
    return out.withColumn("invalid_rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
