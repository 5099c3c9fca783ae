"""YAML by lines: columns become layout tokens, values become scalar, flow and block classes."""

from __future__ import annotations

import re

from codeloom.llm.syntax.languages import table

KEY = re.compile(r"""(?:(?P<plain>[^\s\-?:,\[\]{}#&*!|>'"%@`](?:[^:#\n]|:(?=\S)|(?<=\S)\#)*?|[-?:](?=[^\s,\[\]{}])(?:[^:#\n]|:(?=\S)|(?<=\S)\#)*?)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\n]|'')*'|\*[^\s,\[\]{}]+|<<)[ \t]*:(?=[ \t]|$)""")
PROP = re.compile(r"(?:[&!][^\s,\[\]{}]*)(?=[ \t]|$)")
BLOCK = re.compile(r"[|>][+-]?[1-9]?[+-]?[ \t]*(?:#.*)?$")
FLOW = re.compile(r"""[ \t\r\n]*(?:(\#[^\n]*)|([\[\]{},])|(:)(?=[\s,\[\]{}]|$)|("(?:[^"\\]|\\[\s\S])*"|'(?:[^']|'')*')|(\*[^\s,\[\]{}]+)|([&!][^\s,\[\]{}]*)|((?:[^\s,\[\]{}:#&*!|>'"%@`-]|[-:](?=[^\s,\[\]{}]))(?:[^,\[\]{}:#\n]|:(?=[^\s,\[\]{}])|(?<=\S)\#)*)|$)""")


class Bad(Exception):
    pass


def _rest(s: str) -> bool:
    s = s.strip()
    return not s or s.startswith("#")


class Reader:
    """Tokens (class, line) of a text."""

    def __init__(self, text: str):
        self.lines = text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("\ufeff").split("\n")
        self.n = 0
        self.out: list[tuple[str, int]] = []
        self.levels: list[tuple[int, str]] = []

    def put(self, token: str) -> None:
        self.out.append((token, self.n + 1))

    def close(self, col: int) -> None:
        while self.levels and self.levels[-1][0] > col:
            if self.levels.pop()[1] != "top":
                self.put("DEDENT")

    def quoted(self, s: str, q: str) -> str:
        """The text after a quoted scalar that may go on over lines."""
        pat = re.compile(r'"(?:[^"\\]|\\[\s\S])*"' if q == '"' else r"'(?:[^']|'')*'")
        while True:
            m = pat.match(s)
            if m:
                return s[m.end() :]
            self.n += 1
            if self.n >= len(self.lines):
                raise Bad
            s += "\n" + self.lines[self.n]

    def flow(self, s: str) -> str:
        """Flow tokens up to the end of the collection; the text after it."""
        depth = 0
        while True:
            m = FLOW.match(s)
            if not m or (m.end() == len(s) and m.lastindex is None):
                self.n += 1
                if self.n >= len(self.lines) or (m is None and s.lstrip()[:1] not in "'\"") or re.match(r"(?:---|\.\.\.)(?:\s|$)", self.lines[self.n]):
                    raise Bad
                s = s + "\n" + self.lines[self.n] if m is None else self.lines[self.n]
                continue
            s = s[m.end() :]
            k = m.lastindex
            if k == 2:
                self.put(m[2])
                depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(m[2], 0)
                if depth == 0:
                    return s
            elif k == 3:
                self.put(":")
            elif k == 5:
                self.put("ALIAS")
            elif k == 6:
                self.put("TAG")
            elif k in (4, 7):
                if not (k == 7 and self.out and self.out[-1][0] == "STR"):
                    self.put("STR")

    def value(self, s: str, parent: int) -> None:
        """The value at the rest of a line, as far as its scalar or flow goes, and the end of the line."""
        s = s.strip()
        while True:
            m = PROP.match(s)
            if not m:
                break
            self.put("TAG")
            s = s[m.end() :].strip()
        if not s or s.startswith("#"):
            self.put("N")
            return
        if BLOCK.match(s):
            self.put("BLOCK")
            self.put("N")
            at = self.n + 1
            while at < len(self.lines):
                line = self.lines[at]
                if line.strip() and len(line) - len(line.lstrip(" ")) <= parent:
                    break
                at += 1
            self.n = at - 1
            return
        if s[0] in "\"'":
            rest = self.quoted(s, s[0])
            self.put("STR")
            if not _rest(rest) or (rest.strip() and rest[0] not in " \t"):
                raise Bad
            self.put("N")
            return
        if s[0] in "[{":
            if not _rest(self.flow(s)):
                raise Bad
            self.put("N")
            return
        if s[0] == "*":
            m = re.match(r"\*[^\s,\[\]{}]+", s)
            self.put("ALIAS")
            if not m or not _rest(s[m.end() :]):
                raise Bad
            self.put("N")
            return
        if s[0] in "%@`&!|>,]}" or re.match(r"[-?:](?:\s|$)", s):
            raise Bad
        text = re.split(r"\s#", s)[0]
        if re.search(r":(?:\s|$)", text):
            raise Bad
        self.put("STR")
        comment = text != s
        while not comment and self.n + 1 < len(self.lines):
            line = self.lines[self.n + 1]
            body = line.strip()
            if body and (len(line) - len(line.lstrip(" ")) <= parent or re.match(r"(?:---|\.\.\.)(?:\s|$)", line)):
                break
            if body.startswith("#"):
                break
            if not body:
                ahead = next((x for x in self.lines[self.n + 1 :] if x.strip()), "")
                if not ahead or len(ahead) - len(ahead.lstrip(" ")) <= parent:
                    break
            elif re.search(r":(?:\s|$)", re.split(r"\s#", body)[0]):
                self.n += 1
                raise Bad
            self.n += 1
            comment = bool(re.search(r"\s#", body))
        self.put("N")

    def entry(self, s: str, col: int, fresh: bool) -> None:
        """What stands at a column: a key, a dash, or a value of the node that is open there."""
        if re.match(r"-(?:[ \t]|$)", s):
            if fresh:
                self.open(col, "seq")
            self.put("-")
            rest = s[1:]
            inner = rest.lstrip(" \t")
            at = col + 1 + len(rest) - len(inner)
            if inner and (re.match(r"-(?:[ \t]|$)", inner) or KEY.match(inner)):
                self.put("INDENT")
                self.levels.append((at, "in"))
                self.entry(inner, at, False)
            else:
                self.value(inner, col)
            return
        if re.match(r"\?(?:[ \t]|$)", s):
            if fresh:
                self.open(col, "map")
            self.put("?")
            self.value(s[1:], col)
            return
        m = KEY.match(s)
        if m:
            if fresh:
                self.open(col, "map")
            self.put("KEY")
            self.value(s[m.end() :], col)
            return
        if fresh:
            self.open(col, "map")
        self.value(s, (self.levels[-2][0] if len(self.levels) > 1 else -1) if fresh else col - 1)

    def open(self, col: int, kind: str) -> None:
        if not self.levels:
            self.levels.append((col, "top"))
        else:
            self.put("INDENT")
            self.levels.append((col, "in"))

    def read(self) -> list[tuple[str, int]]:
        while self.n < len(self.lines):
            line = self.lines[self.n]
            body = line.strip(" ")
            if not body.strip() or body.lstrip("\t").startswith("#"):
                self.n += 1
                continue
            if line.startswith("%") and not self.levels:
                self.n += 1
                continue
            if re.match(r"---(?:\s|$)", line):
                self.close(-1)
                self.levels.clear()
                self.put("---")
                rest = line[3:].strip()
                if rest and not rest.startswith("#"):
                    self.value(rest, -1)
                else:
                    self.put("N")
                self.n += 1
                continue
            if re.match(r"\.\.\.(?:\s|$)", line):
                self.close(-1)
                self.levels.clear()
                self.n += 1
                continue
            col = len(line) - len(line.lstrip(" "))
            if line[col] == "\t":
                raise Bad
            self.close(col)
            top = self.levels[-1][0] if self.levels else -1
            if top != col and self.levels and col < self.levels[0][0]:
                raise Bad
            self.entry(line[col:].rstrip(), col, top != col)
            self.n += 1
        self.n -= 1
        self.close(-1)
        return self.out


def first_error(text: str) -> int | None:
    """The line of the first error."""
    t = table("yaml")
    r = Reader(text)
    bad = None
    try:
        tokens = r.read()
    except Bad:
        bad, tokens = min(r.n + 1, len(r.lines)), r.out
    p = t.parser
    stacks = p.start
    for token, n in tokens:
        stacks = p.step(stacks, t.chars[token])
        if not stacks:
            return n
    if bad:
        return bad
    return None if not tokens or p.accepts(stacks) else len(r.lines)
