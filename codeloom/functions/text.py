"""Column functions on paths, lines and texts. All stay JVM-side.

Null inputs give null unless a function says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of a file by its suffix.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "go": "go", "rs": "rust", "c": "cpp", "h": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php",
    "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sc": "scala", "md": "markdown", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json",
    "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell", "html": "html", "css": "css", "scss": "css",
}
#: Suffixes and names of test files.
TEST_SUFFIXES = ["_test.py", "_tests.py", "test.java", "tests.java", "test.scala", "tests.scala", "spec.scala"]
TEST_LIKE_SUFFIXES = ["_test.py", "_tests.py", "test.java", "tests.java", "test.scala", "tests.scala", ".spec.js", ".spec.ts", ".test.js", ".test.ts"]


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def glob_regex(pattern: str) -> str:
    """Anchored regex of a glob: ``*`` crosses ``/``, ``?`` is one character, ``[..]`` a class."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
            while pattern[i + 1 : i + 2] == "*":
                i += 1
        elif c == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def suffix(path: str | Column) -> Column:
    """Lower-case suffix without its dot; empty if there is none or the name only starts with a dot."""
    return F.regexp_extract(F.lower(basename(path)), r"^.+\.([^.]+)$", 1)


def matches_glob(path: str | Column, patterns: list[str]) -> Column:
    """A pattern without ``/`` is matched against the base name, else against the path; no or a bare star pattern matches all."""
    tests = [F.lit(True) if p in ("*", "**", "**/*") else (basename(path) if "/" not in p else _col(path)).rlike(glob_regex(p)) for p in patterns]
    return _any(tests) if patterns else F.lit(True)


def matches_either(path: str | Column, patterns: list[str]) -> Column:
    """A pattern may match the path or its base name; no pattern matches all."""
    return _any([_col(path).rlike(glob_regex(p)) | basename(path).rlike(glob_regex(p)) for p in patterns]) if patterns else F.lit(True)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def contains_ci(text: str | Column, needle: str) -> Column:
    """Literal containment without case (``%`` and ``_`` are ordinary characters)."""
    return F.lower(_col(text)).contains(needle.lower())


def line_span(line: str | Column, query: str, regex: bool = False, case_sensitive: bool = False) -> Column:
    """struct(start, stop) of the first match, 0-based and exclusive; null without a match."""
    line = _col(line)
    if regex:
        pat = query if case_sensitive else "(?i)" + query
        # the text before the first match, by a lazy prefix; whole-line matching keeps the span exact
        found = line.rlike(pat)
        hit = F.regexp_substr(line, F.lit(pat))
        start = F.instr(line, hit) - 1
        return F.when(found, F.struct(F.greatest(start, F.lit(0)).cast("long").alias("start"), (F.greatest(start, F.lit(0)) + F.length(F.coalesce(hit, F.lit("")))).cast("long").alias("stop")))
    at = F.instr(line if case_sensitive else F.lower(line), query if case_sensitive else query.lower())
    return F.when(at > 0, F.struct((at - 1).cast("long").alias("start"), (at - 1 + len(query)).cast("long").alias("stop")))


def boundary_penalty(line: str | Column, start: Column, stop: Column) -> Column:
    """0 if the match is a whole word, else 1."""
    line = _col(line)
    before = F.substring(line, start.cast("int"), 1)
    after = F.substring(line, (stop + 1).cast("int"), 1)
    word = r"^[\p{L}\p{N}_]"
    ok = ((start <= 0) | ~before.rlike(word)) & ((stop >= F.length(line)) | ~after.rlike(word))
    return F.when(ok, 0).otherwise(1).cast("long")


def is_test_path(path: str | Column) -> Column:
    p = F.lower(F.translate(_col(path), "\\", "/"))
    name = basename(p)
    return F.concat(F.lit("/"), p, F.lit("/")).rlike("/tests?/") | name.startswith("test_") | _any([name.endswith(s) for s in TEST_SUFFIXES])


def is_test_like(path: str | Column) -> Column:
    p = F.lower(F.translate(_col(path), "\\", "/"))
    name = basename(p)
    return F.concat(F.lit("/"), p, F.lit("/")).rlike("/tests?/") | p.contains("src/test") | name.startswith("test_") | name.isin("test.py", "tests.py") | _any([name.endswith(s) for s in TEST_LIKE_SUFFIXES])


#: Parts of paths of copied or built files.
BUILT_PARTS = ["/static/", "/vendor/", "/vendors/", "/node_modules/", "/dist/", "/build/", "jquery"]


def is_built_path(path: str | Column) -> Column:
    p = F.lower(_col(path))
    return _any([p.contains(x) for x in BUILT_PARTS])


def normal_path(path: str | Column) -> Column:
    """Canonical key of a path: forward slashes, no ``./`` and no doubled slash; null if it is empty, absolute or climbs."""
    p = F.trim(F.translate(_col(path), "\\", "/"))
    q = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"/{2,}", "/"), r"(?:^|(?<=/))(?:\./)+", ""), r"(?:^|/)\.$", "")
    bad = p.startswith("/") | p.rlike(r"^[A-Za-z]:") | p.rlike(r"(?:^|/)\.\.(?:/|$)") | (q == "")
    return F.when(~bad, q)


def looks_binary(text: str | Column, head: int = 4096) -> Column:
    """A NUL among the first characters."""
    return F.instr(F.substring(_col(text), 1, head), "\0") > 0


def language(path: str | Column, other: str = "text") -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[suffix(path)], F.lit(other))


def format_size(n: str | Column) -> Column:
    """B below 1024, KB below 1024 squared, else MB, with one decimal for the last two."""
    n = _col(n)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", F.bround(n / F.lit(1024.0), 1)), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", F.bround(n / F.lit(1048576.0), 1)), F.lit(" MB")))


def fingerprint(category: str | Column, content: str | Column) -> Column:
    """sha1 of the category and the content in lower case with its white space collapsed."""
    body = F.lower(F.trim(F.regexp_replace(F.coalesce(_col(content), F.lit("")), r"\s+", " ")))
    return F.sha1(F.concat(F.coalesce(_col(category), F.lit("")), F.char(F.lit(0)), body))


def digest(text: str | Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_col(text), 256))


def token_estimate(text: str | Column) -> Column:
    """A quarter of the characters, rounded up; 0 for a null or empty text."""
    return F.coalesce(F.ceil(F.length(_col(text)) / 4), F.lit(0)).cast("long")


def fixed_pieces(text: str | Column, size: int) -> Column:
    """The text in pieces of ``size`` characters; an empty array for an empty text."""
    t = _col(text)
    at = F.sequence(F.lit(0), F.greatest(F.floor((F.length(t) - 1) / size), F.lit(0)).cast("int"))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.transform(at, lambda i: F.substring(t, i * size + 1, F.lit(size))))


def head_and_tail(text: str | Column, keep: int, mark: str = "\n# ... (cut) ...\n") -> Column:
    """A text of more than ``keep`` characters as its halves around a mark."""
    t = _col(text)
    half = keep // 2
    return F.when(F.length(t) > keep, F.concat(F.substring(t, 1, half), F.lit(mark), F.right(t, F.lit(keep - half)))).otherwise(t)


def snippet(text: str | Column, at: Column, before: int = 40, after: int = 80) -> Column:
    """What surrounds the 0-based position ``at``, on one line, with an ellipsis on both sides if anything is left out."""
    t = _col(text)
    start = F.greatest(at - before, F.lit(0))
    stop = F.least(F.length(t), at + after)
    body = F.translate(F.substring(t, (start + 1).cast("int"), (stop - start).cast("int")), "\n", " ")
    return F.when((start > 0) | (stop < F.length(t)), F.concat(F.lit("…"), body, F.lit("…"))).otherwise(body)


def query_words(text: str | Column) -> Column:
    """Lower-case words of at least two characters, CJK counting as word characters."""
    return F.filter(F.split(F.lower(_col(text)), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)


def payload_hash(*cols: str) -> Column:
    """32 hex digits over the named columns as JSON with sorted keys; nulls are left out."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(cols))), 256), 1, 32)


def unit_vector(v: str | Column) -> Column:
    """The vector over its length, in doubles; null for a null, empty or zero vector."""
    d = F.transform(_col(v), lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(n > 0, F.transform(d, lambda x: x / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sampled_digest(text: str | Column, head: int = 512 * 1024, tail: int = 64 * 1024) -> Column:
    """sha256 over the bytes of a text, of a larger one over its first and last bytes: a cheap sign that it may have
    changed, never that it has not. Null for a null text."""
    b = F.encode(_col(text), "UTF-8")
    long = F.concat(F.substring(b, 1, head), F.substring(b, -tail, tail))
    return F.sha2(F.when(F.octet_length(b) > head + tail, long).otherwise(b), 256)
