"""Transformations of code: symbol chunks, comment stripping, body folding, pruning to a token budget.

Quote-aware and syntax-aware steps have no built-in form and run as Arrow UDFs over one text column; the rest is
JVM-side. A null text stays null, an empty one empty.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T

#: Marks of comments that stay.
KEEP = re.compile(r"TODO|FIXME|HACK|NOTE|XXX|BUG|WARNING|DEPRECATED|SECURITY")
SLASH = {"javascript", "typescript", "java", "go", "c", "cpp", "rust", "csharp", "kotlin", "swift", "scala", "php", "css", "scss"}
HASH = {"ruby", "yaml", "toml", "shell", "perl", "r", "properties", "makefile"}
#: Strings are matched so that comment signs inside them are not.
SLASH_SCAN = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|([ \t]*/\*[\s\S]*?\*/|[ \t]*//[^\n]*)")
HASH_SCAN = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|((?:(?<=\s)|(?<![\s\S]))#[^\n]*)")
SQL_SCAN = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|([ \t]*--[^\n]*)")
HTML_SCAN = re.compile(r"((?!))|(<!--[\s\S]*?-->)")


def strip_text(text: str | None, language: str | None) -> str | None:
    """A text without its comments (and docstrings, in Python), but for those with a mark that stays."""
    if not text:
        return text
    lang = (language or "").lower()
    if lang == "python":
        return _strip_python(text)
    scan = HASH_SCAN if lang in HASH else SQL_SCAN if lang == "sql" else HTML_SCAN if lang in ("html", "xml", "markdown") else SLASH_SCAN
    out = scan.sub(lambda m: m[0] if m[2] is None or KEEP.search(m[2]) else "\0", text)
    lines = [x.replace("\0", "").rstrip() if "\0" in x else x for x in out.split("\n") if x.strip("\0 \t\r") or "\0" not in x]
    return "\n".join(lines)


def _strip_python(text: str) -> str:
    gone: set[int] = set()
    try:
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.body:
                first = node.body[0]
                if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) and not KEEP.search(first.value.value):
                    gone.update(range(first.lineno, (first.end_lineno or first.lineno) + 1))
    except (SyntaxError, ValueError, RecursionError):
        pass
    cut: dict[int, int] = {}
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT and not KEEP.search(t.string):
                cut[t.start[0]] = t.start[1]
    except (tokenize.TokenError, SyntaxError, IndentationError):
        pass
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if n in gone:
            continue
        if n in cut:
            line = line[: cut[n]].rstrip()
            if not line:
                continue
        out.append(line)
    return "\n".join(out)


def fold_text(text: str | None, language: str | None, keep: frozenset[str] = frozenset()) -> str | None:
    """A text with the bodies of its functions replaced by a mark, but for the named ones."""
    if not text:
        return text
    if (language or "").lower() == "python":
        try:
            nodes = [n for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name not in keep]
        except (SyntaxError, ValueError, RecursionError):
            return text
        lines = text.split("\n")
        drop: dict[int, int] = {}
        for n in nodes:
            a, b = n.body[0].lineno, n.end_lineno or n.body[-1].lineno
            if b > a or a > n.lineno:
                drop[a] = max(drop.get(a, 0), b)
        out, i = [], 1
        while i <= len(lines):
            if i in drop:
                lead = re.match(r"\s*", lines[i - 1])[0]
                out.append(f"{lead}...  # folded")
                i = drop[i] + 1
            else:
                out.append(lines[i - 1])
                i += 1
        return "\n".join(out)
    return _fold_braces(text, keep)


HEAD = re.compile(r"(?:^|\n)[^\n;{}]*?\b(\w+)\s*\([^;{}]*\)[^;{}()]*\{")


def _fold_braces(text: str, keep: frozenset[str]) -> str:
    out, at = [], 0
    for m in HEAD.finditer(text):
        if m.start() < at or m[1] in keep or m[1] in ("if", "for", "while", "switch", "catch", "synchronized"):
            continue
        depth, i = 1, m.end()
        for x in re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*[\s\S]*?\*/|[{}]").finditer(text, m.end()):
            depth += {"{": 1, "}": -1}.get(x[0], 0)
            i = x.end()
            if depth == 0:
                break
        if depth == 0 and i - m.end() > 40:
            out.append(text[at : m.end()] + " /* folded */ }")
            at = i
    return "".join(out) + text[at:]


def _udf(fn) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, lang in batches:
            yield pd.Series([fn(t, x) for t, x in zip(text, lang)], dtype="object")

    return run


def stripped(text: Column, language: Column) -> Column:
    return _udf(strip_text)(text, language)


def folded(text: Column, language: Column, keep: list[str] | None = None) -> Column:
    names = frozenset(keep or [])
    return _udf(lambda t, x: fold_text(t, x, names))(text, language)


def pruned(items: DataFrame, request: str, item: str, priority: str, text: str, language: str, budget: int, least: int = 64) -> DataFrame:
    """(request, item, strategy, tokens_in, tokens_out, content): items of a request by falling priority, kept, stripped,
    folded, cut to what is left (if at least ``least`` tokens are) or dropped, in this order, within the budget.

    The cascade is sequential per request: a partition is sorted by request and priority and read as a stream, so a
    request of any number of items needs one batch of memory. Tokens are a quarter of the characters.
    """
    x = items.select(F.col(request).alias("r"), F.col(item).alias("i"), F.coalesce(F.col(priority).cast("double"), F.lit(0.0)).alias("p"), F.coalesce(text, F.lit("")).alias("t"), F.coalesce(language, F.lit("")).alias("l"))
    kinds = dict(x.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, left = None, budget
        for pdf in batches:
            out = []
            for r, i, t, lang in zip(pdf["r"], pdf["i"], pdf["t"], pdf["l"]):
                if r != current:
                    current, left = r, budget
                n = -(-len(t) // 4)
                body, how = t, "keep"
                if n > left:
                    body, how = strip_text(t, lang), "strip"
                if -(-len(body) // 4) > left:
                    body, how = fold_text(body, lang), "fold"
                m = -(-len(body) // 4)
                if m > left:
                    if left >= least:
                        mark = "\n# ... (cut) ...\n"
                        room = left * 4 - len(mark)
                        body, how = body[: room // 2] + mark + body[len(body) - (room - room // 2) :], "truncate"
                        m = -(-len(body) // 4)
                    else:
                        body, how, m = "", "drop", 0
                left -= m
                out.append((r, i, how, n, m, body))
            yield pd.DataFrame(out, columns=["r", "i", "strategy", "tokens_in", "tokens_out", "content"])

    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartition(n, "r").sortWithinPartitions("r", F.desc("p"), "i")
    done = x.mapInPandas(run, f"r {kinds['r']}, i {kinds['i']}, strategy string, tokens_in long, tokens_out long, content string")
    return done.select(F.col("r").alias(request), F.col("i").alias(item), "strategy", "tokens_in", "tokens_out", "content")


def symbol_chunks(files: DataFrame, keys: list[str], path: str, text: str, whole: int = 4000) -> DataFrame:
    """keys.., chunk_type, name, start, stop, content, chunk_id: an overview of each file (first lines and names) and the
    stretch of lines from each declaration to the next; a file without one is a chunk of its first characters."""
    from codeloom.operators import symbols
    from codeloom.operators.text import lines

    ls = lines(files, keys, text)
    part = ", ".join(f"`{k}`" for k in keys)
    syms = symbols.symbols(ls, keys).withColumn("stop", F.expr(f"lead(line_start) over (partition by {part} order by line_start) - 1"))
    all_lines = F.split(F.col(text), "\n", -1)
    body = files.select(*keys, all_lines.alias("_ls"), F.col(text).alias("_t"))
    # a file meets all its symbols once, and only their stretches leave it
    told = syms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_start", "name", "kind", "stop"))).alias("_syms"))
    o = body.join(told, keys, "left").withColumn("_has", F.col("_syms").isNotNull())
    o = o.withColumn("_names", F.slice(F.transform("_syms", lambda s: s["name"]), 1, 30))
    at = o.select(*keys, "_ls", F.explode("_syms").alias("s")).withColumn("stop", F.coalesce("s.stop", F.size("_ls").cast("long")))
    kind = F.when(F.col("s.kind").isin("class", "trait", "object", "interface", "enum", "struct", "union", "impl", "record", "mod", "namespace"), "class").otherwise("function")
    stretch = F.array_join(F.slice("_ls", F.col("s.line_start").cast("int"), (F.col("stop") - F.col("s.line_start") + 1).cast("int")), "\n")
    own = at.select(*keys, kind.alias("chunk_type"), "s.name", F.col("s.line_start").alias("start"), "stop", stretch.alias("content"))
    head = F.array_join(F.slice("_ls", 1, 20), "\n")
    over = F.concat(F.lit("# "), F.col(path), F.lit("\n"), head, F.lit("\n# "), F.array_join(F.coalesce("_names", F.array().cast("array<string>")), ", "))
    rest = o.select(*keys, F.when(F.col("_has"), "file_overview").otherwise("file").alias("chunk_type"), F.lit("").alias("name"), F.lit(1).cast("long").alias("start"), F.size("_ls").cast("long").alias("stop"), F.when(F.col("_has"), over).otherwise(F.substring("_t", 1, whole)).alias("content"))
    both = own.unionByName(rest.where("content is not null"))
    n = F.expr(f"row_number() over (partition by {part} order by start, chunk_type desc, name)") - 1
    return both.withColumn("chunk_id", F.concat_ws(":", F.col(path), "chunk_type", "name", F.col("start").cast("string"), n.cast("string")))


def token_count(text: str | Column) -> Column:
    return T.token_estimate(text)
