"""Tell hand-written source from tool output, minified or bundled scripts, third-party copies and data.

One Aho-Corasick automaton over the lower-cased text finds every fixed part of a notice in one pass; each hit is
then checked where it stands: it has to be in a comment, and the comment has to read as a notice about the file
itself, so that a program which writes such notices is not one. Path rules find lock files and the directories
of packages. Shape rules, which need no notice, find minified lines, module bundles, tables of literals and
bodies of numbered members. The whole text is read, without a shuffle; Python workers get Arrow batches of two
columns.

Defined results
- ``reason`` is null for hand-written files; else the first of: lock_file, vendored_path, third_party_notice,
  generated_notice, bundle, minified, literal_data, numbered_members.
- Null or blank contents and saved web pages have no reason, whatever their path: an empty file is no one's copy. A null
  path only loses the path rules.
- Every file below a directory of packages counts as copied, directly below it too. A holder named in ``own`` never makes a file third-party; a directory of packages does even without a notice,
  unless a comment names an own holder and none names another.
- Rows are judged one by one; repeated rows get the same reason. Extra columns are untouched by the column form.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of notices for the automaton, lower case.
GENERATED_PARTS = ["code generated", "generated by", "@generated", "auto-generated", "autogenerated", "auto generated", "automatically generated", "automatically produced", "automatically created", "machine generated", "machine-generated", "generated from", "generated file", "file is generated", "file was generated", "was created by", "was produced by", "is produced by", "generated automatically", "generated with"]
THIRD_PARTY_PARTS = ["copyright", "spdx-filecopyrighttext", "(c)", "copied from", "vendored from", "imported from", "taken from", "adapted from", "/*!", "@license"]
BUNDLE_PARTS = ["/***/", "__webpack_require__", "sourcemappingurl="]
#: Marks that parser generators leave in their tables.
TABLE_PARTS = ["#line ", "_lr_action_items", "_lr_goto_items", "yytype_int16", "yypact[]"]
LINE_MARK = re.compile(r'#line \d+ "[^"\n]+\.(?:y|yy|l|ll|lex|g|g4|rl|re|peg)"')

#: How a comment about the whole file begins or goes on.
GENERATED_NOTICE = re.compile(
    r"(?:@generated\b"
    r"|<auto-?generated>"
    r"|code generated (?:by|from|with) \S+"
    r"|(?:this (?:file|code|module|source) (?:is|was|has been) )?(?:auto-?\s?|automatically |machine[- ])(?:generated|produced|created)\b(?! at run)"
    r"|this (?:file|code|module|source) (?:is|was|has been) (?:generated|produced|created) (?:by|from|with|automatically) "
    r"|(?:generated|produced|created) (?:by|from|with) (?!hand\b|us\b)\S+.*?(?:do not (?:edit|modify|change|touch)|don't (?:edit|modify)|edit that|edit the|from the|will be lost|overwritten|regenerate|instead|\.(?:proto|y|g4|idl|thrift|avsc|xsd)\b)"
    r"|generated file\b"
    r"|generated (?:by|with) [\w.-]+ v?\d[\d.]*\W*$)",
    re.I,
)
COPYRIGHT = re.compile(r"copyright\s+(?:\(c\)\s*|©\s*)?\d{4}(?:\s*[-,]\s*\d{4})*,?\s+(?:by\s+)?(.+)|spdx-filecopyrighttext:\s*(?:\d{4}\s+)?(.+)|\(c\)\s+(?:\d{4}\s+)?(.+)", re.I)
COPIED = re.compile(r"(?:copied|vendored|imported|taken|adapted) from (?:the )?[\w@./-]+ v?\d+\.\d[\w.-]*\b", re.I)
BANNER = re.compile(r"/\*!\s*[\w@./-]+\s+v?\d+\.\d")

#: Path rules.
PACKAGE_DIRS = {"node_modules", "bower_components", "jspm_packages", "vendor", "_vendor", "third_party", "third-party", "thirdparty", "external", "externals", "site-packages", "dist-packages", "deps", "contrib", "Pods", "Carthage", "Godeps"}
LOCK_NAME = re.compile(r"(?i)(?:package-lock\.json|npm-shrinkwrap\.json|composer\.lock|yarn\.lock|pnpm-lock\.ya?ml|bun\.lockb?|poetry\.lock|pipfile\.lock|uv\.lock|cargo\.lock|gemfile\.lock|podfile\.lock|go\.sum|flake\.lock|mix\.lock|gradle\.lockfile|packages\.lock\.json|[\w.-]+\.lock\.json|[\w.-]+\.lock)$")
MIN_NAME = re.compile(r"(?i)(?:[.-]min|\.bundle|\.chunk|-[0-9a-f]{8,20})\.(?:js|cjs|mjs|css|ts)$")
SCRIPT = re.compile(r"(?i)\.(?:js|cjs|mjs|jsx|ts|css)$")
CODE = re.compile(r"(?i)\.(?:py|pyi|js|cjs|mjs|jsx|ts|tsx|java|kt|scala|go|c|h|cc|cpp|hpp|cs|rb|php|rs|swift)$")
WEB_PAGE = re.compile(r"\s*(?:<!doctype html|<html\b)", re.I)
LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|0x[0-9a-fA-F]+|(?<![\w.])\d[\w.]*')
NUMBERED = re.compile(r"(?<=[A-Za-z_])\d{1,4}(?![0-9])")
ANY_NUMBER = re.compile(r"(?<![0-9])\d{1,4}(?![0-9])")
COMMENT = re.compile(r"[ \t]*(?:#(?!include|define|if|endif|else|undef|line)|//+|/\*+|\*+(?!/)|--|;+|<!--|%+|\"\"\"|''')[ \t!*#/]*")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[A-Za-z_]\w*")
NUMBER = re.compile(r"-?\b\d[\w.]*")
QUOTED = re.compile(r'"[^"\n]*"|\'[^\'\n]*\'')
KEY = re.compile(r'"([^"\\\n]*)"\s*:')
JSON_PART = re.compile(r'("(?:[^"\\\n]|\\.)*")(\s*:)?|([\[{])|([\]}])|(-?\d[\w.+-]*)|(true|false|null)')


@lru_cache(maxsize=1)
def automaton():
    """The automaton of all notice parts, made once per Python worker."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, parts in (("g", GENERATED_PARTS), ("t", THIRD_PARTY_PARTS), ("b", BUNDLE_PARTS), ("y", TABLE_PARTS)):
        for p in parts:
            a.add_word(p, (kind, len(p)))
    a.make_automaton()
    return a


def comment_at(text: str, pos: int) -> str | None:
    """The comment text of the line of ``pos``, if the line is or lies in a comment."""
    start = text.rfind("\n", 0, pos) + 1
    end = text.find("\n", pos)
    line = text[start : end if end >= 0 else len(text)]
    m = COMMENT.match(line)
    if m:
        return line[m.end() :].rstrip("\r */->")
    if text.rfind("/*", 0, pos) > text.rfind("*/", 0, pos) or text.rfind("<!--", 0, pos) > text.rfind("-->", 0, pos):
        return line.strip(" \t\r*/->")
    return None


def notices(text: str, own: tuple[str, ...]) -> set[str]:
    """Of 'generated', 'third_party', 'own' and 'bundle' those that comments of the text state."""
    found: set[str] = set()
    low = text.lower()
    if len(low) != len(text):  # characters that change length in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    marks = 0
    for end, (kind, size) in automaton().iter(low):
        at = end - size + 1
        if kind == "b":
            marks += 1 if low.startswith("/***/", at) else 2
            if low.startswith("sourcemappingurl", at):
                line = low.rfind("\n", 0, at) + 1
                if low[line:at].lstrip() in ("//# ", "//@ ", "/*# "):
                    found.add("map")
            continue
        if kind == "y":
            start = low.rfind("\n", 0, at) + 1
            if LINE_MARK.match(text, at) if low[at] == "#" else not low[start:at].strip(" \tstaticon"):
                found.add("generated")
            continue
        body = comment_at(text, at)
        if body is None:
            continue
        if kind == "g":
            if "generated" not in found and GENERATED_NOTICE.match(body):
                found.add("generated")
        elif low.startswith("/*!", at):
            if BANNER.match(text, at):
                found.add("third_party")
        elif COPIED.match(body):
            found.add("third_party")
        else:
            m = COPYRIGHT.search(body)
            if m:
                holder = next(x for x in m.groups() if x).lower()
                found.add("own" if any(o.lower() in holder for o in own) else "third_party")
    if marks >= 3:
        found.add("bundle")
    return found


def literal_share(text: str) -> tuple[int, float]:
    """How many literals a text has, and their share of its characters that are not white space."""
    n = size = 0
    for m in LITERAL.finditer(text):
        n += 1
        size += m.end() - m.start()
    dense = len(text) - sum(map(text.count, " \n\t\r"))
    return n, size / dense if dense else 0.0


def shapes(text: str) -> tuple[list[str], set[str]]:
    """The lines of code of a text, and their shapes with words, numbers and strings made equal."""
    lines = [x for x in (line.strip() for line in text.split("\n")) if x and not COMMENT.match(x)]
    return lines, {SPACE.sub("", WORD.sub("w", NUMBER.sub("0", QUOTED.sub("S", x)))) for x in lines}


def json_bulk(text: str) -> bool:
    """At least 200 literals lie directly in arrays, or are the numbers of maps, and are most of all literals."""
    stack: list[str] = []
    in_arrays = numbers = every = 0
    for m in JSON_PART.finditer(text):
        if m[3]:
            stack.append(m[3])
        elif m[4]:
            if stack:
                stack.pop()
        elif not m[2]:
            every += 1
            in_arrays += bool(stack) and stack[-1] == "["
            numbers += bool(m[5]) and (not stack or stack[-1] == "{")
    return in_arrays >= 200 and in_arrays >= 0.5 * every or numbers >= 200 and numbers >= 0.9 * every


def is_data(text: str, path: str) -> bool:
    """Bulk literals: in code, most of the text in lines that are hardly more than literals; in JSON, many
    records under few keys, long arrays under any keys, or large maps of numbers."""
    if path.lower().endswith(".json"):
        keys = KEY.findall(text)
        if len(keys) >= 40 and len(set(keys)) <= 0.15 * len(keys):
            return True
        return not keys and len(LITERAL.findall(text)) >= 200 or json_bulk(text)
    if not CODE.search(path):
        return False
    n, share = literal_share(text)
    if share < 0.55 or n < 12:
        return False
    rows = size = whole = 0
    for line in text.split("\n"):
        dense = len(line) - sum(map(line.count, " \t\r"))
        whole += dense
        if dense >= 8:
            m, part = literal_share(line)
            if (m >= 2 and part >= 0.55) or part >= 0.9:
                size += dense
                rows += m
    return rows >= 12 and size >= 0.75 * whole


def numbered_members(text: str) -> bool:
    """A body of members numbered without a gap from 0, nearly every line naming a number, in few shapes."""
    numbers = {int(x) for x in NUMBERED.findall(text)}
    k = 0
    while k in numbers:
        k += 1
    if k < 4:
        return False
    lines, kinds = shapes(text)
    named = sum(1 for x in lines if any(int(y) <= k for y in ANY_NUMBER.findall(x)))
    return len(lines) <= 14 * k and named >= 0.6 * len(lines) and len(kinds) <= max(14, 0.3 * len(lines))


def is_minified(text: str, path: str) -> bool:
    """Script text with hardly any white space, in long lines or under a name for it."""
    if not SCRIPT.search(path):
        return False
    n = len(text)
    space = sum(map(text.count, " \n\t\r"))
    longest = max(map(len, text.split("\n")))
    if MIN_NAME.search(path):
        return space < 0.1 * n
    return space < 0.06 * n and longest >= 120


def reason(path: str | None, content: str | None, own: tuple[str, ...] = ()) -> str | None:
    """Why a file is not hand-written source, or None."""
    if not content or not content.strip() or WEB_PAGE.match(content):
        return None
    path = (path or "").replace("\\", "/")
    parts = path.split("/")
    if LOCK_NAME.match(parts[-1]) or ('"lockfileVersion"' in content and '"integrity"' in content):
        return "lock_file"
    found = notices(content, own)
    if any(x in PACKAGE_DIRS for x in parts[:-1]) and ("own" not in found or "third_party" in found):
        return "vendored_path"
    if "third_party" in found:
        return "third_party_notice"
    if "generated" in found:
        return "generated_notice"
    if "bundle" in found:
        return "bundle"
    if is_minified(content, path) or ("map" in found and SCRIPT.search(path)):
        return "minified"
    if is_data(content, path):
        return "literal_data"
    if CODE.search(path) and numbered_members(content):
        return "numbered_members"
    return None


def reason_column(path: str | Column, content: str | Column, own: tuple[str, ...] = ()) -> Column:
    """``reason`` as a column of Arrow batches."""

    @F.pandas_udf("string")
    def judged(p: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([reason(a, b, own) for a, b in zip(p, c)], dtype="object")

    return judged(path, content)
