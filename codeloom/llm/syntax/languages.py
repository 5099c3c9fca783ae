"""Lexers to token classes and the rules of lines (layout, inserted semicolons) of each language."""

from __future__ import annotations

import re
from functools import lru_cache

from codeloom.llm.syntax import grammars as G
from codeloom.llm.syntax.engine import END, Grammar, Parser

#: Classes of one character that are no terminals: a break inside a token, an error, layout.
BREAK, ERROR = "\x01", "\x02"
INDENT_BASE = 0xE000
TEXTS = {"json": G.JSON, "python": G.PYTHON, "javascript": G.JAVASCRIPT, "typescript": G.TYPESCRIPT, "java": G.JAVA, "go": G.GO, "c": G.C, "yaml": G.YAML, "toml": G.TOML}
STARTS = {"json": "Value", "python": "File", "javascript": "Program", "typescript": "Program", "java": "Unit", "go": "File", "c": "File", "yaml": "Stream", "toml": "File"}
PREFER = {"javascript": (("Block", "Object"), ("Func", "FuncExpr"), ("Class", "ClassExpr")), "typescript": (("Block", "Object"), ("Func", "FuncExpr"), ("FuncHead", "FuncExpr"), ("Class", "ClassExpr"))}
#: Spellings of languages.
NAMES = {
    "py": "python", "python3": "python", "js": "javascript", "node": "javascript", "ecmascript": "javascript", "ts": "typescript", "golang": "go", "yml": "yaml", "h": "c", "ansi c": "c",
    "bash": "shell", "sh": "shell", "zsh": "shell", "env": "properties", "dotenv": "properties", "ini": "properties",
}
#: Keywords of a language that spell a terminal otherwise.
SPELLED = {"c": {"_Static_assert": "static_assert", "_Bool": "bool", "_Complex": "complex", "_Noreturn": "noreturn", "__inline": "inline", "__inline__": "inline", "__restrict": "restrict", "__const": "const", "__volatile__": "volatile", "__asm__": "asm", "__asm": "asm", "__attribute__": "attribute", "__attribute": "attribute", "__typeof__": "typeof", "_Alignof": "alignof", "_Alignas": "alignas", "_Thread_local": "thread", "thread_local": "thread", "_Generic": "generic"}}


def language_of(name: str | None) -> str | None:
    """The language behind a spelling."""
    if name is None:
        return None
    n = name.strip().lower().lstrip(".")
    return NAMES.get(n, n) or None


class Table:
    """Terminals, grammar and parser of a language."""

    def __init__(self, lang: str):
        text = TEXTS[lang]
        heads = {m[1] for m in re.finditer(r"(?m)^([A-Z]\w*):", text)}
        symbols = set()
        for line in text.split("\n"):
            for s in line.partition(":")[2].split():
                if s == "|" or s == "EMPTY":
                    continue
                if s[0].isalpha():
                    s = re.sub(r"(?:%,,|%,|[?*+])$", "", s)
                if s not in heads:
                    symbols.add("|" if s == "BAR" else s)
        symbols |= {",", *([] if lang in ("yaml", "json", "toml", "python") else [";", "}"])}
        self.chars = {s: chr(0x100 + i) for i, s in enumerate(sorted(symbols))}
        self.ops = {s: c for s, c in self.chars.items() if not s[0].isalpha()}
        for name, ops in G.CLASSES[lang].items():
            if name in self.chars:
                for o in ops.split():
                    self.ops.setdefault(o, self.chars[name])
        self.words = {s: c for s, c in self.chars.items() if s[0].isalpha() and not s.isupper()}
        for word, s in SPELLED.get(lang, {}).items():
            if s in self.chars:
                self.words[word] = self.chars[s]
        if lang == "c":
            for s in ("attribute", "generic", "complex", "noreturn", "thread"):
                self.words.pop(s, None)
        self.op_pattern = "|".join(re.escape(o) for o in sorted(self.ops, key=len, reverse=True))
        self.parser = Parser(Grammar(text, STARTS[lang], self.chars, PREFER.get(lang, ())))


@lru_cache(maxsize=None)
def table(lang: str) -> Table:
    """Made once per Python worker and language."""
    return Table(lang)


# Lexers. Each returns the text as token classes; "\n" separates lines.

IDENT = r"[^\W\d]\w*"
JS_IDENT = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:\w|\$|\\u[0-9a-fA-F]{4})*"
C_NUMBER = r"(?:0[xX][0-9a-fA-F'.]+(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[a-zA-Z]{0,4}(?![\w.])"
JS_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$])"
JAVA_NUMBER = r"(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?!\w)"
GO_NUMBER = r"(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w)"
PY_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"
QUOTE2 = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'
QUOTE1 = r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
REGEX_BODY = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
TPL_PLAIN = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`"
TPL_DEEP = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^`{}]|\{[^`{}]*\}|`[^`]*`)*\})*`"
TPL_PART = re.compile(r"\\[\s\S]|\$\{((?:[^`{}]|\{[^`{}]*\}|`[^`]*`)*)\}")
#: A formatted string of Python: prefix, quotes, what lies between.
FSTRING = re.compile(r"([fFrR]{1,2})(?:\"\"\"|\'\'\'|[\"'])([\s\S]*?)(?:\"\"\"|\'\'\'|[\"'])\Z")


class Lexer:
    """A scanner by one pattern: space, then an alternative per kind of token."""

    def __init__(self, lang: str):
        self.lang = lang
        t = self.t = table(lang)
        w, num, s = t.chars.get("ID", ""), t.chars.get("NUM", ""), t.chars.get("STR", "")
        ops = t.op_pattern
        space = r"[ \t\r\f\v\ufeff\xa0]*"
        self.words, self.w, self.num, self.s = t.words, w, num, s
        if lang in ("javascript", "typescript"):
            op_regex = rf"((?:{ops})|\b(?:return|typeof|case|in|of|delete|void|throw|else|do|yield|await)|\n)(?<![\])}}])([ \t]*)({REGEX_BODY})"
            pat = rf"{space}(?:({JS_IDENT})(?!\s*/[^/*])|({JS_NUMBER})|({QUOTE2}|{QUOTE1})|(//[^\n]*|{BLOCK_COMMENT})|({TPL_PLAIN}|{TPL_DEEP})|(\#{JS_IDENT})|{op_regex}|({JS_IDENT})|({ops})|(\n)|\Z|([\s\S]))"
        elif lang == "java":
            pat = rf'{space}(?:({IDENT})|({JAVA_NUMBER})|("""[ \t\f]*\r?\n(?:[^\\]|\\[\s\S])*?"""|{QUOTE2}|\'(?:[^\'\\\n]|\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)\')|(//[^\n]*|{BLOCK_COMMENT})|({ops})|(\n)|\Z|([\s\S]))'
        elif lang == "go":
            pat = rf"{space}(?:({IDENT})|({GO_NUMBER})|({QUOTE2}|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|[0-7]{{3}}|.))'|`[^`]*`)|(//[^\n]*|{BLOCK_COMMENT})|({ops})|(\n)|\Z|([\s\S]))"
        elif lang == "c":
            pat = rf"{space}(?:((?:[LuU]|u8)?(?:{QUOTE2}|{QUOTE1}))|({C_NUMBER})|({IDENT})|(//(?:[^\\\n]|\\(?:\r?\n|.))*|{BLOCK_COMMENT}|(?:(?<=\n)|(?<![\s\S]))[ \t]*\#(?:[^\\\n/]|\\(?:\r?\n|.)|/(?!\*)|{BLOCK_COMMENT})*|\\\r?\n)|({ops})|(\n)|\Z|([\s\S]))"
        elif lang == "python":
            f1 = r"(?:[^'\\\n{]|\\(?:\r\n|[\s\S])|\{\{|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*'"
            f2 = r'(?:[^"\\\n{]|\\(?:\r\n|[\s\S])|\{\{|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*"'
            strings = rf"""[bBuUrR]{{0,2}}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|{QUOTE2}|{QUOTE1})|(?:[fF][rR]?|[rR][fF])(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|"{f2}|'{f1})"""
            pat = rf"[ \t\f]*(?:({strings})|({IDENT})|({PY_NUMBER})|(\#[^\n]*|\\\r?\n)|({ops})|\r?\n([ \t\f]*)|\Z|([\s\S]))"
        elif lang == "json":
            pat = r'[ \t\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(true|false|null)\b|([{}\[\],:])|(\n)|\Z|([\s\S]))'
        elif lang == "toml":
            strings = r'"(?!"")(?:[^"\\\n]|\\.)*"|\'(?!\'\')[^\'\n]*\''
            multi = r"\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"+|'''[\s\S]*?'''+"
            scalar = r"[+-]?(?:inf|nan)\b|true\b|false\b|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?|0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?"
            pat = rf"[ \t\r]*(?:({multi})|({strings})|(\#[^\n]*)|(\n)|((?:{scalar})(?![\w-]))|([A-Za-z0-9_-]+)|(\[\[|\]\]|[\[\]{{}},.=])|\Z|([\s\S]))"
        self.scan = re.compile(pat)
        self.cache: dict[str, str] = {}

    def classes(self, text: str) -> str:
        return self.scan.sub(getattr(self, "_" + {"typescript": "javascript"}.get(self.lang, self.lang)), text)

    def _javascript(self, m: re.Match) -> str:
        k = m.lastindex
        if k == 1 or k == 10:
            return self.words.get(m[k], self.w)
        if k == 11:
            return self.t.ops[m[11]]
        if k == 12:
            return "\n"
        if k == 2:
            return self.num
        if k == 3:
            return self.s + BREAK * m[3].count("\n")
        if k == 4:
            return "\n" * m[4].count("\n")
        if k == 5:
            return self._template(m[5])
        if k == 6:
            return self.t.chars.get("PRIVATE", ERROR)
        if k == 9:
            lead = "\n" if m[7] == "\n" else self.t.ops.get(m[7]) or self.words.get(m[7], self.w)
            return lead + self.t.chars["REGEX"]
        if k is None:
            return ""
        return ERROR

    def _template(self, text: str) -> str:
        if "${" in text:
            for p in TPL_PART.finditer(text):
                if p[1] is not None and not self._expression(p[1]):
                    return ERROR
        return self.t.chars["TPL"] + BREAK * text.count("\n")

    def _expression(self, text: str) -> bool:
        body = self.classes(text).replace("\n", "").replace(BREAK, "")
        got = self.cache.get(body)
        if got is None:
            p, c = self.t.parser, self.t.ops
            stacks = p.run(p.start, c["("] + body + c[")"] + c[";"]) if ERROR not in body and body else ()
            got = self.cache[body] = "y" if stacks and p.accepts(stacks) else "n"
        return got == "y"

    def _java(self, m: re.Match) -> str:
        k = m.lastindex
        if k == 1:
            return self.words.get(m[1], self.w)
        if k == 5:
            return self.t.ops[m[5]]
        if k == 6:
            return "\n"
        if k == 2:
            return self.num
        if k == 3:
            return self.s + BREAK * m[3].count("\n")
        if k == 4:
            return "\n" * m[4].count("\n")
        return ERROR if k else ""

    _go = _java

    def _c(self, m: re.Match) -> str:
        k = m.lastindex
        if k == 3:
            return self.words.get(m[3], self.w)
        if k == 5:
            return self.t.ops[m[5]]
        if k == 6:
            return "\n"
        if k == 2:
            return self.num
        if k == 1:
            return self.s + BREAK * m[1].count("\n")
        if k == 4:
            return BREAK * m[4].count("\n")
        return ERROR if k else ""

    def _python(self, m: re.Match) -> str:
        k = m.lastindex
        if k == 2:
            return self.words.get(m[2], self.w)
        if k == 5:
            return self.t.ops[m[5]]
        if k == 6:
            return "\n" + chr(INDENT_BASE + len(m[6].expandtabs(8)) % 4000)
        if k == 1:
            if m[1][0] in "fF" or m[1][1] in "fF":
                f = FSTRING.match(m[1])
                if f and not self._fields(f[2], "r" in f[1].lower()):
                    return ERROR
            return self.s + BREAK * m[1].count("\n")
        if k == 3:
            return self.num
        if k == 4:
            return BREAK if m[4][0] == "\\" else ""
        return ERROR if k else ""

    def _fields(self, body: str, raw: bool) -> bool:
        """Whether the replacement fields of a formatted string parse."""
        i = 0
        while i < len(body):
            c, nxt = body[i], body[i + 1 : i + 2]
            if c in "{}" and nxt == c:
                i += 2
            elif c == "{":
                i = self._field(body, i + 1)
                if i < 0:
                    return False
            elif c == "}":
                return False
            elif c == "\\" and not raw and body.startswith("\\N{", i):
                i = body.find("}", i) + 1
                if not i:
                    return False
            else:
                i += 2 if c == "\\" and nxt not in ("{", "}") else 1
        return True

    def _field(self, body: str, start: int) -> int:
        """The position after the field that begins at ``start``, or -1: an expression, ``=``, a conversion, a format that
        may hold fields itself."""
        depth, i, n = 0, start, len(body)
        while i < n:
            m = self.scan.match(body, i)
            token = m[0].lstrip(" \t\f") if m else ""
            if not token:
                return -1
            at = m.end() - len(token)
            if m.lastindex not in (1, 2, 3):
                if token[0] in "([{":
                    depth += 1
                elif depth and token[0] in ")]}":
                    depth -= 1
                elif not depth and (token[0] in "}:" or token == "!"):
                    i = at
                    break
            i = m.end()
        else:
            return -1
        expr = body[start:i]
        if re.search(r"(?<![=!<>])=\s*$", expr):
            expr = expr.rstrip()[:-1]
        if not self._field_expression(expr):
            return -1
        if body[i] == "!":
            m = re.compile(r"![sra][ \t]*(?=[:}])").match(body, i)
            if not m:
                return -1
            i = m.end()
        if body[i] == ":":
            i += 1
            while i < n and body[i] != "}":
                if body[i] == "{":
                    i = self._field(body, i + 1)
                    if i < 0:
                        return -1
                else:
                    i += 1
        return i + 1 if i < n else -1

    def _field_expression(self, text: str) -> bool:
        if not text.strip():
            return False
        got = self.cache.get("f" + text)
        if got is None:
            body = re.sub(rf"\n[{chr(INDENT_BASE)}-{chr(INDENT_BASE + 4000)}]?", "", self.classes(text)).replace(BREAK, "")
            p, c = self.t.parser, self.t.chars
            stacks = p.run(p.start, c["("] + body + c[")"] + c["N"]) if ERROR not in body and body else ()
            got = self.cache["f" + text] = 1 if stacks and p.accepts(stacks) else 0
        return got == 1

    def _json(self, m: re.Match) -> str:
        k = m.lastindex
        if k == 1:
            return self.s
        if k == 2:
            return self.num
        if k == 3:
            return self.words[m[3]]
        if k == 4:
            return self.t.ops[m[4]]
        if k == 5:
            return "\n"
        return ERROR if k else ""

    def _toml(self, m: re.Match) -> str:
        k, c = m.lastindex, self.t.chars
        if k == 6:
            return c["KEY"]
        if k == 7:
            return c[m[7]]
        if k == 5:
            return c["NUM"]
        if k == 2:
            return c["STR"]
        if k == 1:
            return c["MSTR"] + BREAK * m[1].count("\n")
        if k == 3:
            return ""
        if k == 4:
            return c["N"] + "\n"
        return ERROR if k else ""


@lru_cache(maxsize=None)
def lexer(lang: str) -> Lexer:
    return Lexer(lang)


# Parsers. Each returns None or the 1-based line of the first error that nothing repairs.


def _plain(lang: str, text: str) -> int | None:
    lx = lexer(lang)
    p = lx.t.parser
    stacks, n = p.start, 0
    tail = lx.t.chars["N"] if lang == "toml" else ""
    for line in (lx.classes(text) + tail).split("\n"):
        n += 1
        if BREAK in line:
            extra = line.count(BREAK)
            line = line.replace(BREAK, "")
        else:
            extra = 0
        if line:
            stacks = p.run(stacks, line)
            if not stacks:
                return n
        n += extra
    return None if p.accepts(stacks) else n


def _go(lang: str, text: str) -> int | None:
    lx = lexer(lang)
    p, t = lx.t.parser, lx.t
    semi = t.ops[";"]
    ends = {lx.w, lx.num, lx.s, *(t.words[x] for x in ("break", "continue", "fallthrough", "return")), *(t.ops[x] for x in ("++", ")", "]", "}"))}
    stacks, n = p.start, 0
    for line in lx.classes(text).split("\n"):
        n += 1
        extra = line.count(BREAK)
        if extra:
            line = line.replace(BREAK, "")
        if line:
            stacks = p.run(stacks, line + semi if line[-1] in ends else line)
            if not stacks:
                return n
        n += extra
    return None if p.accepts(stacks) else n


def _script_line(p: Parser, stacks: tuple[int, ...], line: str, semi: str, close: str, inc: str) -> tuple[int, ...]:
    """A line of a script with the semicolons that the language inserts."""
    key = (stacks, "\n" + line)
    out = p.lines.get(key)
    if out is not None:
        return out
    out, first = stacks, True
    for c in line:
        nxt = p.step(out, c)
        if first and c == inc:
            put = p.step(out, semi)
            nxt = tuple(sorted(set(nxt) | set(p.step(put, c)))) if put else nxt
        if not nxt and (first or c == close):
            put = p.step(out, semi)
            nxt = p.step(put, c) if put else ()
        out, first = nxt, False
        if not out:
            break
    p.lines[key] = out
    return out


def _script(lang: str, text: str) -> int | None:
    lx = lexer(lang)
    p, ops = lx.t.parser, lx.t.ops
    semi, close, inc = ops[";"], ops["}"], ops["++"]
    stacks, n = p.start, 0
    if text.startswith("#!"):
        text = "//" + text
    for line in lx.classes(text).split("\n"):
        n += 1
        extra = line.count(BREAK)
        if extra:
            line = line.replace(BREAK, "")
        if line:
            stacks = _script_line(p, stacks, line, semi, close, inc)
            if not stacks:
                return n
        n += extra
    if p.accepts(stacks):
        return None
    put = p.step(stacks, semi)
    return None if put and p.accepts(put) else n


def _python(lang: str, text: str) -> int | None:
    lx = lexer(lang)
    p, c = lx.t.parser, lx.t.chars
    newline, indent, dedent = c["N"], c["INDENT"], c["DEDENT"]
    opens, closes = (c["("], c["["], c["{"]), (c[")"], c["]"], c["}"])
    text = text.removeprefix("\ufeff")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in text:
        return text.count("\n", 0, text.index("\0")) + 1
    depths: dict[str, int] = lx.cache
    stacks, n, depth, levels = p.start, 0, 0, [0]
    for line in lx.classes("\n" + text).split("\n")[1:]:
        n += 1
        extra = line.count(BREAK)
        if extra:
            line = line.replace(BREAK, "")
        if len(line) > 1:
            body = line[1:]
            lead = ""
            if depth == 0:
                col = ord(line[0]) - INDENT_BASE
                if col > levels[-1]:
                    levels.append(col)
                    lead = indent
                else:
                    while col < levels[-1]:
                        levels.pop()
                        lead += dedent
                    if col != levels[-1]:
                        return n
            d = depths.get(body)
            if d is None:
                d = depths[body] = sum(map(body.count, opens)) - sum(map(body.count, closes))
            depth = max(0, depth + d)
            stacks = p.run(stacks, lead + body + (newline if depth == 0 else ""))
            if not stacks:
                return n
        n += extra
    stacks = p.run(stacks, dedent * (len(levels) - 1)) if len(levels) > 1 else stacks
    return None if depth == 0 and stacks and p.accepts(stacks) else n


def first_error(language: str | None, text: str | None) -> int | None:
    """The line of the first error of a text in a language; None if it is valid, null, or without a grammar."""
    lang = language_of(language)
    if text is None or lang not in TEXTS:
        return None
    p = table(lang).parser
    if p.full():
        p.reset()
        if lang != "yaml":
            lexer(lang).cache.clear()
    if lang == "yaml":
        from codeloom.llm.syntax.yaml_lines import first_error as yaml_error

        return yaml_error(text)
    if lang == "python":
        return _python(lang, text)
    if lang in ("javascript", "typescript"):
        return _script(lang, text)
    if lang == "go":
        return _go(lang, text)
    return _plain(lang, text)
