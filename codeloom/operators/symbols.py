"""Symbols by declaration patterns, tiered search, fuzzy search, definitions and lexical call edges.

Patterns are per line; a symbol is what a declaration keyword names. Null lines declare nothing. Search ranks are total
orders: score, exact case, classes first, name, path, line.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a declaration, its modifiers, keyword and name.
DECLARATION = r"^(\s*)(?:(?:public|private|protected|static|final|abstract|sealed|case|open|override|implicit|lazy)\s+)*(class|trait|object|interface|enum|def|async\s+def|function|func)\s+([A-Za-z_][A-Za-z0-9_]*)\b"


#: Further declarations by suffix of the path: (suffixes, pattern, kind or number of its group, group of the name).
FORMS = [
    (["go"], r"^func\s+(?:\([^)]*\)\s*)([A-Za-z_]\w*)", "method", 1),
    (["go"], r"^type\s+([A-Za-z_]\w*)\s+(struct|interface)\b", 2, 1),
    (["rs"], r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|default)\s+)*(fn|struct|enum|trait|union|mod)\s+([A-Za-z_]\w*)", 1, 2),
    (["rs"], r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)", "impl", 1),
    (["java", "kt", "scala", "cs"], r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*record\s+([A-Za-z_]\w*)", "record", 1),
    (["java", "cs"], r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|override|virtual|async)\s+)*(?:<[^>]+>\s+)?(?:void|int|long|double|float|boolean|bool|char|byte|short|string|[A-Z]\w*(?:<[^()]*>)?)(?:\[\])*\s+([A-Za-z_]\w*)\s*\([^;={}]*(?:\)\s*(?:throws\s+[\w., ]+)?\s*[{;]?\s*|,\s*)$", "method", 1),
    (["js", "jsx", "cjs", "mjs", "ts", "tsx"], r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+|async\s+|declare\s+)*(class|interface|enum|function)\s*\*?\s+([A-Za-z_$][\w$]*)", 1, 2),
    (["js", "jsx", "cjs", "mjs", "ts", "tsx"], r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::\s*[\w<>\[\] |.]+)?\s*=>|[A-Za-z_$][\w$]*\s*=>)", "function", 1),
    (["js", "jsx", "cjs", "mjs", "ts", "tsx"], r"^\s+(?:(?:public|private|protected|static|readonly|async|get|set|override)\s+)*([A-Za-z_$][\w$]*)\s*\([^;={}]*\)\s*(?::\s*[\w<>\[\] |.]+)?\s*\{\s*$", "method", 1),
    (["c", "h", "cc", "cpp", "hpp", "cxx"], r"^\s*(?:typedef\s+)?(struct|union|enum|class|namespace)\s+([A-Za-z_]\w*)\s*(?:final\s*)?(?::[^;]*)?\{?\s*$", 1, 2),
    (["c", "h", "cc", "cpp", "hpp", "cxx"], r"^(?:[A-Za-z_][\w:<>]*[\s*&]+)+([A-Za-z_][\w:]*)\s*\([^;={}]*\)\s*(?:const\s*)?\{?\s*$", "function", 1),
]
#: Words that begin statements and declare nothing.
STATEMENTS = ["if", "for", "while", "switch", "catch", "return", "else", "do", "try", "function", "with", "new", "throw", "typeof", "await", "super", "constructor", "sizeof", "defined"]


def _declared() -> Column:
    """(name, kind) of the first declaration form that a line with ``_suffix`` has; the general one comes first."""
    general = F.regexp_extract("line", DECLARATION, 3)
    found = [F.when(general != "", F.struct(general.alias("name"), F.regexp_replace(F.regexp_extract("line", DECLARATION, 2), r"\s+", " ").alias("kind")))]
    for suffixes, pattern, what, at in FORMS:
        kind = F.regexp_extract("line", pattern, what) if isinstance(what, int) else F.lit(what)
        got = F.regexp_extract("line", pattern, at)
        found.append(F.when(F.col("_suffix").isin(suffixes) & (got != "") & ~got.isin(STATEMENTS), F.struct(got.alias("name"), kind.alias("kind"))))
    return F.coalesce(*found)


def symbols(ls: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """keys.., name, kind, line_start, signature, by the general form and those of the path's language."""
    suffix = F.lower(F.substring_index(path, ".", -1)) if path in ls.columns else F.lit("")
    out = ls.withColumn("_suffix", suffix)  # every form begins at the line's begin, so most lines fail at once
    # the generator reads each form once, where a filter on the result would read it again
    out = out.select(*keys, "line_no", "line", F.explode(F.filter(F.array(_declared()), lambda x: x.isNotNull())).alias("_d"))
    return out.select(*keys, F.col("_d.name").alias("name"), F.col("_d.kind").alias("kind"), F.col("line_no").alias("line_start"), F.substring(F.trim("line"), 1, 200).alias("signature"))


def tier(name: str | Column, query: str) -> Column:
    """1.0 exact, 0.9 prefix, 0.7 contained, without case; null otherwise."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    q = query.strip().lower()
    return F.when(n == q, 1.0).when(n.startswith(q), 0.9).when(n.contains(q), 0.7)


def search(syms: DataFrame, query: str, path: str, kind: str | None = None, fuzzy: bool = True, min_score: float = 0.5, limit: int = 20) -> DataFrame:
    """Tiered search; if any name is exact, only exact ones come out. ``fuzzy`` admits the contained tier."""
    rows = syms.withColumn("score", tier("name", query)).where(F.col("score") >= (min_score if fuzzy else max(min_score, 0.9)))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    rank = [F.desc("score"), F.desc(F.col("name") == query.strip()), F.desc(F.col("kind") == "class"), F.lower("name"), path, "line_start"]
    top = rows.orderBy(*rank).limit(limit)  # exact names come first, so one at the top tells whether there is any
    return top.withColumn("_best", F.expr("max(score) over ()")).where((F.col("_best") < 1.0) | (F.col("score") == 1.0)).drop("_best").orderBy(*rank)


def similarity(a: Column, b: Column) -> Column:
    """100 less the share of edits in the longer name."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))


def fuzzy_score(name: Column, query: str) -> Column:
    """Tiers, then edit similarity of at least 60 as 0.5 + (similarity - 60) / 100, at most 0.95."""
    ratio = similarity(F.lower(name), F.lit(query.strip().lower()))
    return F.coalesce(tier(name, query), F.when(ratio >= 60, F.least(F.lit(0.95), 0.5 + (ratio - 60) / 100)))


def weighted_ratio(name: Column, query: str) -> Column:
    """0..100: the best of plain, partial and token ratios of difflib, partial ones at nine tenths."""

    @F.pandas_udf("double")
    def rated(s: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        q = query.strip().lower()

        def one(n: str | None) -> float:
            n = (n or "").lower()
            if not n or not q:
                return 0.0
            plain = SequenceMatcher(None, q, n).ratio()
            short, long = sorted((q, n), key=len)
            m = SequenceMatcher(None, short, long).find_longest_match()
            at = max(0, m.b - m.a)
            partial = SequenceMatcher(None, short, long[at : at + len(short)]).ratio() * 0.9
            words = [" ".join(sorted(x.replace("_", " ").split())) for x in (q, n)]
            return 100 * max(plain, partial, SequenceMatcher(None, *words).ratio() * 0.95)

        return s.map(one).astype("float64")

    return rated(name)


def nth(syms: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n-th symbol of each name under the keys, the last if there are fewer."""
    part = ", ".join(f"`{k}`" for k in [*keys, "name"])
    x = syms.withColumn("_r", F.expr(f"row_number() over (partition by {part} order by line_start)")).withColumn("_n", F.expr(f"count(*) over (partition by {part})"))
    return x.where(F.col("_r") == F.least(F.col("_n"), F.lit(max(1, n)))).drop("_r", "_n")


def enclosing(ls: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with ``inside``: the callable that was declared last at or above them."""
    part = ", ".join(f"`{k}`" for k in keys)
    name = F.when(F.regexp_extract("line", DECLARATION, 2).rlike("def|func"), F.regexp_extract("line", DECLARATION, 3))
    return ls.withColumn("_d", name).withColumn("inside", F.expr(f"last(_d, true) over (partition by {part} order by line_no)")).drop("_d")


#: What holds members.
HOLDERS = "class|trait|object|interface|enum"


def members(ls: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., owner, member: callables declared deeper than the class last declared above them, by the general form."""
    part = ", ".join(f"`{k}`" for k in keys)
    lead, kind, name = (F.regexp_extract("line", DECLARATION, i) for i in (1, 2, 3))
    x = ls.where(F.col("line").rlike(DECLARATION)).select(*keys, "line_no", F.length(lead).alias("_at"), kind.rlike(f"^(?:{HOLDERS})$").alias("_holds"), name.alias("_name"))
    x = x.withColumn("_own", F.when(F.col("_holds"), F.struct(F.col("_name").alias("name"), F.col("_at").alias("at"))))
    x = x.withColumn("_in", F.expr(f"last(_own, true) over (partition by {part} order by line_no)"))
    return x.where(~F.col("_holds") & (F.col("_at") > F.col("_in.at"))).select(*keys, F.col("_in.name").alias("owner"), F.col("_name").alias("member")).distinct()


#: Words before a parenthesis that call nothing.
NOT_CALLED = ["if", "for", "while", "switch", "catch", "return", "function", "def", "func", "class", "elif", "with", "and", "or", "not", "in", "is", "print", "sizeof", "synchronized", "import", "new", "assert", "raise", "except", "lambda", "await", "yield", "else", "case"]


def call_edges(ls: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., caller, callee, line: names before a parenthesis inside a callable, its own declaration aside."""
    x = enclosing(ls, keys).where("inside is not null")
    body = F.regexp_replace("line", DECLARATION, "")
    x = x.select(*keys, F.col("inside").alias("caller"), F.col("line_no").alias("line"), F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1))).alias("callee"))
    return x.where(~F.col("callee").isin(NOT_CALLED)).select(*keys, "caller", "callee", "line")


#: Inheritance by language family, as (pattern, group of the child, group of the parents).
INHERITANCE = [
    (r"^\s*class\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*:", "inherits"),
    (r"^\s*(?:export\s+|default\s+|public\s+|final\s+|abstract\s+|static\s+)*(?:class|interface)\s+([A-Za-z_$][\w$]*)(?:<[^>]*>)?\s+extends\s+([\w$.<>, ]+?)(?:\s+implements\b.*)?\s*\{?\s*$", "extends"),
    (r"^\s*(?:export\s+|default\s+|public\s+|final\s+|abstract\s+|static\s+)*class\s+([A-Za-z_$][\w$]*)(?:<[^>]*>)?(?:\s+extends\s+[\w$.<>]+)?\s+implements\s+([\w$.<>, ]+?)\s*\{?\s*$", "implements"),
    (r"^\s*(?:class|struct)\s+([A-Za-z_]\w*)(?:\s+final)?\s*:\s*((?:public|private|protected|virtual)\s[^{;]*)", "inherits"),
    (r"^\s*impl(?:<[^>]*>)?\s+([A-Za-z_]\w*)(?:<[^>]*>)?\s+for\s+([A-Za-z_]\w*)", "impl"),
]


def inheritance(ls: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., child, parent, edge_type, line from class heads; keyword bases such as a metaclass are edges of that kind."""
    out = None
    for pattern, kind in INHERITANCE:
        a, b = F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2)
        child, parents = (b, a) if kind == "impl" else (a, b)
        x = ls.withColumn("child", child).where("child <> ''").select(*keys, "child", F.explode(F.split(parents, ",")).alias("_p"), F.col("line_no").alias("line"))
        named = F.regexp_extract("_p", r"^\s*metaclass\s*=\s*(\S+)", 1)
        parent = F.when(named != "", named).otherwise(F.regexp_replace(F.regexp_replace(F.trim("_p"), r"<.*$", ""), r"^(?:(?:public|private|protected|virtual)\s+)+", ""))
        x = x.select(*keys, "child", parent.alias("parent"), F.when(named != "", "metaclass").otherwise(kind).alias("edge_type"), "line").where("parent <> '' and not parent like '%=%'")
        out = x if out is None else out.unionByName(x)
    return out.distinct()


#: Import lines, as patterns of the module in group 1; the first that fits holds.
IMPORTS = [
    r"""^\s*import\s+(?:[\w{}*,\s$]+\s+from\s+)?["']([^"']+)["']""",
    r"^\s*from\s+([\w.]+)\s+import\b",
    r"^\s*import\s+(?:static\s+)?([\w.]+)",
    r"""\brequire\(\s*["']([^"']+)["']\s*\)""",
    r"""^\s*#include\s*[<"]([^>"]+)[>"]""",
]


def imports(ls: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., imported, line for python, java, script and go import lines and C includes."""
    found = F.coalesce(*[F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1)) for p in IMPORTS])
    return ls.where(F.col("line").rlike(r"\b(?:import|require|include)\b")).withColumn("imported", found).where("imported is not null").select(*keys, "imported", F.col("line_no").alias("line"))
