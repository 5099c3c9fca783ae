"""Find credentials in source and configuration and mask them in place.

One Aho-Corasick automaton holds the fixed starts of token formats, key armour, connection strings and the words
that name credentials. Long texts are scanned in overlapping windows; each hit is read by the grammar of its
kind from the whole text, and equal or nested absolute spans are merged. String literals that are continued over
lines are read as one through a view without the joints, whose offsets map back. Masking splices placeholders
into the spans and leaves every other character as it is.

Rules for what counts
- Formats count wherever they stand: cloud key ids, forge, chat and service tokens, signed web tokens, basic and
  bearer values, secret webhook addresses, addresses with a password, private key armour.
- A literal under a name for a credential counts if it looks random or like a password: no white space, letters
  and digits, of any length and script; a quoted one also if it is digits only, or has no digit but is eight small
  letters or more but no word for a state, joins three words, mixes case with signs or looks random. In comments
  that speak of a credential, key or login, so does a word with digits and length or signs.
- Placeholders, references to the environment or a vault, hashes, checksums, ids and public keys do not count.

Defined results
- A null or empty text has no spans and stays as it is. ``line_no`` counts from 1 by "\\n"; a value over several
  lines counts at its first, a private key at its BEGIN line, even if its end is missing.
- Spans do not overlap and come in order. Repeated rows give the same spans.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Window of the scan and how far windows overlap (more than the longest fixed part).
WINDOW, OVERLAP = 1 << 16, 64

#: Starts of formats, lower case, with the grammar that reads on from there.
TOKEN_STARTS = {
    "akia": "aws", "asia": "aws",
    "ghp_": "forge", "gho_": "forge", "ghu_": "forge", "ghs_": "forge", "ghr_": "forge", "github_pat_": "forge", "glpat-": "forge",
    "xoxa-": "chat", "xoxb-": "chat", "xoxp-": "chat", "xoxr-": "chat", "xoxs-": "chat", "xapp-": "chat",
    "sk-": "service", "sk_live_": "service", "rk_live_": "service", "_live_": "service", "-live-": "service", "-prod-": "service", "_prod_": "service", "_test_": "service", "npm_": "service", "pypi-": "service", "aiza": "service", "hf_": "service", "dop_v1_": "service", "shpat_": "service", "sg.": "service",
    "eyj": "jwt", "-----begin": "armor", "://": "address", "basic ": "basic", "bearer ": "bearer", "hooks": "webhook", "webhook": "webhook",
}
#: Parts of names of credentials, lower case.
NAME_PARTS = ["passw", "passphrase", "passcode", "pass", "pwd", "pw", "secret", "token", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "privatekey", "private_key", "private-key", "signing", "servicekey", "service_key", "service-key", "encryptionkey", "encryption_key", "masterkey", "master_key", "sharedkey", "shared_key", "accountkey", "account_key", "storage_key", "storagekey", "deploy_key", "deploykey", "authkey", "auth_key", "credential", "authoriz", "auth"]
#: Further words of comments that speak of a credential or of something left behind, lower case.
COMMENT_PARTS = ["key", "login", "cred", "curl", "user", "works", "use", "try", "todo", "fixme", "xxx", "hack", "temp", "remove", "drop", "leak", "rotate"]

GRAMMARS = {
    "aws": re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "forge": re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,255}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,})"),
    "chat": re.compile(r"(?<![A-Za-z0-9])x(?:ox[abprs]|app)-(?=[A-Za-z0-9-]*\d)[A-Za-z0-9-]{16,}"),
    "service": re.compile(
        r"(?<![A-Za-z0-9])(?:sk-(?:[a-z]+-)*(?=[A-Za-z0-9_-]*\d)[A-Za-z0-9_-]{20,}|[a-z]{2,8}[-_](?:live|prod|test)[-_](?=[A-Za-z0-9]*\d)[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{40,}|AIza[A-Za-z0-9_-]{35}|hf_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{64}|shpat_[0-9a-f]{32}|SG\.[\w-]{16,}\.[\w-]{16,})"
    ),
    "jwt": re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?"),
    "bearer": re.compile(r"(?<![A-Za-z0-9])[Bb]earer (?=[^\s\"'`]*\d)([A-Za-z0-9._~+/-]{16,}=*)"),
    "basic": re.compile(r"(?<![A-Za-z0-9])[Bb]asic ([A-Za-z0-9+/_-]{8,}={0,2})"),
    "webhook": re.compile(r"(?:hooks?|webhooks?)[\w.-]*(?::\d+)?/[^\s\"'`<>]*?/([A-Za-z0-9_-]{16,})(?![\w/-])"),
}
ARMOR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
ARMOR_BODY = re.compile(r"(?:(?:\\r)?\\n|[\s\"'`+,\\]){0,12}(?:[A-Za-z-]+: [^\n]*\n)*\s*[A-Za-z0-9+/=]{10,}")
ARMOR_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
ARMOR_REST = re.compile(r"(?:[A-Za-z0-9+/=]|\\r|\\n|\s|[\"'`+,](?=\s|[\"'`]))*")
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^\s:/@\"'`<>]*):([^\s/\"'`<>]+?)@(?=[\w\[$%{.-]|$|[\"'`])")
JOINT = re.compile(r"([\"'`])[ \t]*(?:[+.&]|\\)?[ \t]*\r?\n[ \t]*(?:[+.&][ \t]*)?[rbfu]?\1")
QUOTED = re.compile(r"[rbfuL]{0,2}([\"'`])((?:(?!\1)[^\\\n]|\\.)*)(?:\1|(?=\n)|$)")
GAP = re.compile(r"\d*[\"'\]]{0,3}(?:\[\d*\])?[ \t]*(?::[ \t]*(?:str|string|String)[ \t]*=|:=|=>|[:=]|[)\]]*[ \t]*(?:\|\||\?\?|\bor\b)|,[ \t]*Value:|,(?=[ \t]*[\"']))[ \t]*\(?[ \t]*(?:\n[ \t]*)?(?:(?:[A-Za-z_][\w.]*(?:\[[^\]\n]*\])?(?:\([^()\n]*\))?)[ \t]*(?:\|\||\?\?|\bor\b|\?:)[ \t]*|(?:os\.(?:getenv|environ\.get)|getenv|System\.getProperty)\([ \t]*[\"'][^\"'\n]*[\"'][ \t]*,[ \t]*)?")
BARE = re.compile(r"(?:=|:[ \t]+)([^\s\"'`(){}\[\],;]+)[ \t]*(?:#[^\n]*)?\r?(?=\n|\Z)")
NAME = re.compile(r"[A-Za-z0-9_.$-]*")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
COMMENT_LINE = re.compile(r"^[ \t]*(?:#|//|/\*|\*|--|;|<!--)|(?<=\s)(?:#|//)\s", re.M)
TERM = re.compile(r"[^\s\"'`,;()<>]+")

#: Names and values that are no credentials.
LAST_WORDS = {"password", "passwords", "passwd", "pwd", "pw", "pass", "passphrase", "passcode", "secret", "secrets", "token", "apikey", "credential", "credentials", "authorization", "auth", "pat", "accesskey", "secretkey", "privatekey", "signingkey"}
KEY_KINDS = {"api", "access", "secret", "private", "signing", "service", "encryption", "master", "shared", "account", "storage", "deploy", "auth", "client", "license", "hmac", "jwt", "aes", "app", "admin", "webhook", "root"}
LAST_ENDS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "accesskey", "secretkey", "signingkey", "servicekey", "privatekey", "authheader")
SIDE_WORDS = {"alt", "old", "new", "prev", "previous", "current", "prod", "production", "dev", "staging", "local", "backup", "value", "default", "main", "primary", "secondary", "ci", "live", "next", "legacy"}
DUMMY = re.compile(
    r"(?i)^(?:[x*.•_#-]+|\$.*|%.*|\{.*|<.*|\[.*|env[:.].*|vault[:.].*|secrets?[:.].*|ref[:+].*|ssm[:.].*|arn:.*|op://.*|.*\$\s?\{.*|.*\{\{.*|.*\.\.\..*|.*…)$"
    r"|process\.env|os\.environ|getenv|change[-_ ]?me|your[-_ ]|placeholder|redacted|example\b|dummy|replace[-_ ]?(?:me|this)|not-a-real|^todo\b|^fixme\b|insert[-_ ]|x{6,}|\*{4,}|^(?:none|null|true|false|undefined|nil|test|secret|password|passwd|pass|token)\d*$|^ssh-|begin public|begin certificate|:\w+\($"
)
UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
#: Single words that settings give for a credential without being one.
STATES = {"required", "optional", "disabled", "enabled", "unknown", "missing", "invalid", "expired", "forgotten", "incorrect", "rejected", "accepted", "rotated", "revoked", "refreshed", "encrypted", "plaintext", "anonymous", "credentials", "authorization", "username", "keychain", "keystore", "environment", "kubernetes", "unauthorized", "authenticated"}
NAME_WORDS = {"password", "passwords", "token", "tokens", "secret", "secrets", "key", "keys", "auth", "header", "headers", "field", "label", "user", "name", "id", "type", "path", "file", "url", "input", "form", "reset", "manager", "service", "provider", "store", "config", "settings", "value", "error", "hash", "prefix"}
VERSION = re.compile(r"(?i)^[a-z]{0,12}@?v?\d+(?:\.\d+)+(?:[-+.]?[a-z]+\.?\d*)?$")
HASHED = re.compile(r"(?i)^(?:sha\d*|md5|blake2\w?)[:-]")


@lru_cache(maxsize=1)
def automaton():
    """All fixed parts in one automaton, made once per Python worker."""
    import ahocorasick

    a = ahocorasick.Automaton()
    words: dict[str, list[str]] = {}
    for p, kind in TOKEN_STARTS.items():
        words.setdefault(p, []).append(kind)
    for p in NAME_PARTS:
        words.setdefault(p, []).extend(["name", "comment"])
    for p in COMMENT_PARTS:
        words.setdefault(p, []).append("comment")
    for p, kinds in words.items():
        a.add_word(p, (tuple(kinds), len(p)))
    a.make_automaton()
    return a


def hits(low: str) -> Iterator[tuple[int, str]]:
    """(position, kind) of every fixed part, from overlapping windows, each once."""
    a, n, at = automaton(), len(low), 0
    done = -1
    while at < n:
        for end, (kinds, size) in a.iter(low, at, min(n, at + WINDOW)):
            if end > done:
                for k in kinds:
                    yield end - size + 1, k
        done = min(n, at + WINDOW) - 1
        at += WINDOW - OVERLAP


def lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def is_dummy(value: str) -> bool:
    return not value or DUMMY.search(value) is not None


def random_letters(value: str) -> bool:
    """A word of letters no one would write: many changes of case, or a long run without a vowel."""
    if len(value) < 12 or not value.isalpha() or not value.isascii() or len(set(value)) < 8:
        return False
    changes = sum(a.islower() and b.isupper() for a, b in zip(value, value[1:]))
    return changes >= 0.2 * len(value) or re.search(r"(?i)[bcdfghjklmnpqrstvwxz]{7}", value) is not None and value[1:] != value[1:].upper()


def password_words(value: str) -> bool:
    """A value without a digit that can only be a password under a credential's name: eight or more small letters, or
    three or more words joined by hyphens or underscores, neither a state nor a name."""
    low = value.lower()
    if value.isalpha():
        return len(value) >= 8 and value.islower() and low not in STATES and not any(low.endswith(e) for e in LAST_ENDS)
    words = re.split(r"[-_]", low)
    return len(words) >= 3 and len(value) >= 14 and all(w.isalpha() for w in words) and not NAME_WORDS.intersection(words) and value == low


def looks_secret(value: str, strict: bool = False, quoted: bool = False) -> bool:
    """Letters and digits without white space, neither placeholder, id, hash nor public key.

    ``strict`` is for words of running text: they also need length or a sign within. ``quoted`` is for literals under
    a credential's name: they may lack digits or letters."""
    if len(value) < 6 or any(c.isspace() for c in value) or is_dummy(value) or UUID.match(value) or HASHED.match(value):
        return False
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    if quoted and not digits:
        signs = any(not c.isalnum() and c not in "-_.:/," for c in value)  # the rest also joins the words of names
        return signs and any(map(str.islower, value)) and any(map(str.isupper, value)) and re.search(r"[(){}<>\[\]\\]", value) is None or random_letters(value) or password_words(value)
    if quoted and digits == len(value):
        return len(set(value)) > 1
    if not digits or not letters or strict and not value.isascii() or not any(c.lower() != c.upper() for c in value):
        return False
    if strict:
        if VERSION.match(value):
            return False
        if "/" in value and not re.search(r"[A-Za-z0-9+/]{24,}", value):
            return False
        return len(value) >= 20 or re.search(r"[a-z0-9][!@#$%^&*+_.-][A-Za-z0-9]|\d[a-z]+\d|[a-z]x[a-z]+\d{3}", value) is not None and digits >= 2
    return True


def is_name(name: str) -> bool:
    """Whether an identifier names a credential itself (not its label, kind, length ...)."""
    words = [w.lower() for w in WORDS.findall(name)]
    while len(words) > 1 and words[-1] in SIDE_WORDS:
        words.pop()
    if not words:
        return False
    last = words[-1]
    if last in LAST_WORDS or any(last.endswith(e) for e in LAST_ENDS):
        return True
    if last == "key":
        return len(words) > 1 and words[-2] in KEY_KINDS
    return last == "header" and len(words) > 1 and words[-2] in ("auth", "authorization")


class View:
    """A text with its continued string literals joined, and the way back to the text's offsets."""

    def __init__(self, text: str):
        self.cuts: list[int] = []  # positions in the view before which something was left out
        self.gaps: list[int] = []  # how much up to there
        out, at, off, size = [], 0, 0, 0
        if "\n" in text and JOINT.search(text):
            for m in JOINT.finditer(text):
                out.append(text[at : m.start()])
                size += m.start() - at
                off += m.end() - m.start()
                self.cuts.append(size)
                self.gaps.append(off)
                at = m.end()
        self.text = text if not self.cuts else "".join(out) + text[at:]

    def back(self, pos: int) -> int:
        i = bisect_right(self.cuts, pos) - 1
        return pos + (self.gaps[i] if i >= 0 else 0)

    def spans(self, start: int, end: int) -> list[tuple[int, int]]:
        """The stretches of the text that a span of the view covers."""
        out = []
        i = bisect_right(self.cuts, start)
        while i < len(self.cuts) and self.cuts[i] < end:
            out.append((self.back(start), self.back(self.cuts[i] - 1) + 1))
            start = self.cuts[i]
            i += 1
        out.append((self.back(start), self.back(end - 1) + 1))
        return out


def _basic(value: str) -> bool:
    raw = value.rstrip("=").replace("-", "+").replace("_", "/")
    raw = raw[: len(raw) // 4 * 4]
    try:
        plain = base64.b64decode(raw, validate=True).decode("ascii")
    except (binascii.Error, ValueError, UnicodeDecodeError):
        return False
    user, colon, word = plain.partition(":")
    return bool(colon and user and user.isprintable() and word.isprintable() and not is_dummy(word))


def _armor(text: str, at: int) -> tuple[int, int] | None:
    m = ARMOR.match(text, at)
    if not m:
        return None
    if text[m.end() :].strip("\\nr \t\r\n") and not ARMOR_BODY.match(text, m.end()):
        return None
    stop = ARMOR_END.search(text, m.end())
    again = ARMOR.search(text, m.end())
    if stop and not (again and again.start() < stop.start()):
        between = text[m.end() : stop.start()]
        if len(re.sub(r"[A-Za-z0-9+/=\s\\\"'`+,:.-]", "", between)) <= 4:
            return at, stop.end()
    rest = ARMOR_REST.match(text, m.end())
    end = rest.end() if rest else m.end()
    return at, max(m.end(), len(text[:end].rstrip(" \t\r\n\"'`+,")))


def _token(text: str, kind: str, at: int) -> tuple[int, int] | None:
    """The span that the grammar of a kind reads around the hit."""
    if kind == "armor":
        return _armor(text, at)
    if kind == "address":
        start = at
        while start > 0 and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
            start -= 1
        m = ADDRESS.match(text, start)
        if m and not is_dummy(m[2]) and not re.fullmatch(r"(?i)(?:pw|xxx+|\w*password|secret)", m[2]):
            return m.start(2), m.end(2)
        return None
    start = max(0, at - 9) if kind == "service" else at
    pos = text.rfind("\n", start, at) + 1 or start
    while pos <= at:  # the token starts at or shortly before the hit, and ends where its grammar ends it
        m = GRAMMARS[kind].match(text, pos)
        pos = max(pos + 1, m.end()) if m else pos + 1
        if not m or m.end() <= at:
            continue
        if kind == "basic" and not _basic(m[1]) or kind in ("bearer", "webhook") and (is_dummy(m[1]) or not looks_secret(m[1])):
            return None
        if not m.lastindex and is_dummy(m[0]):
            return None
        return (m.start(1), m.end(1)) if m.lastindex else (m.start(), m.end())
    return None


def _opens_line(text: str, at: int) -> bool:
    """Whether nothing but an object, quotes, signs and a word such as export stands before a name in its line."""
    if text[at - 1 : at] == ".":
        while at > 0 and (text[at - 1].isalnum() or text[at - 1] in "_.-"):
            at -= 1
    for _ in range(2):
        while at > 0 and text[at - 1] in " \t\"'-":
            at -= 1
        if at == 0 or text[at - 1] == "\n":
            return True
        at -= next((len(w) for w in ("export", "set", "ENV", "ARG") if text.endswith(w, max(0, at - len(w)), at)), 0)
    return False


def _named(text: str, at: int) -> tuple[int, tuple[int, int] | None]:
    """(where the identifier around the hit ends, the literal given to it, if it names a credential and the literal
    looks like one)."""
    start = at
    while start > 0 and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "_-$"):
        start -= 1
    stop = NAME.match(text, at).end()
    name = text[start:stop].rstrip("-.")
    end = start + len(name)
    if not is_name(name):
        return stop, None
    gap = GAP.match(text, end)
    if gap:
        m = QUOTED.match(text, gap.end())
        if m:
            return stop, (m.start(2), m.end(2)) if looks_secret(m[2], quoted=True) else None
    m = BARE.match(text, end)
    if m and looks_secret(m[1]) and _opens_line(text, start):
        return stop, (m.start(1), m.end(1))
    return stop, None


def _in_comment(text: str, at: int, since: int) -> tuple[int, list[tuple[int, int]]]:
    """(up to where the text was read, secret-looking words of a comment that speaks of a key or a login).

    Up to ``since`` the text was read already: without finding a comment, if ``at`` is still in the same line."""
    line = text.rfind("\n", since, at) + 1
    m = COMMENT_LINE.search(text, line or max(0, since - 2), at + 1)
    if not m:
        return at, []
    stop = text.find("\n", at)
    stop = len(text) if stop < 0 else stop
    out = []
    for t in TERM.finditer(text, at, stop):
        a, b = t.start(), t.end()
        word = t[0]
        if "://" in word:
            continue
        if ":" in word and not HASHED.match(word):
            a += word.index(":") + 1
            word = text[a:b]
        if looks_secret(word.rstrip("."), strict=True):
            out.append((a, a + len(word.rstrip("."))))
    return stop, out


def find(text: str | None) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
    """(start, end, kind, stretches) of each credential, in order; stretches are what masking replaces."""
    if not text:
        return []
    view = View(text)
    got: dict[tuple[int, int], str] = {}
    v = view.text
    read = named = 0
    for at, kind in hits(lower(v)):
        if kind == "comment":
            if at >= read and not v[at - 1 : at].isalpha():  # a comment line is read once, from its first such word on
                read, spans = _in_comment(v, at, read)
                for span in spans:
                    got.setdefault(span, "comment")
        else:
            if kind == "name":
                if at < named:  # the same identifier
                    continue
                named, span = _named(v, at)
            else:
                span = _token(v, kind, at)
            if span and span[0] < span[1]:
                if kind != "name" or span not in got:
                    got[span] = "password" if kind == "name" else kind
    out: list[tuple[int, int, str, list[tuple[int, int]]]] = []
    last = -1
    for (a, b), kind in sorted(got.items(), key=lambda x: (x[0][0], -x[0][1])):
        if b <= last:
            continue
        if a < last:
            a = last
        parts = view.spans(a, b)
        out.append((parts[0][0], parts[-1][1], kind, parts))
        last = b
    return out


def mask(text: str | None) -> str | None:
    """The text with each credential replaced by a placeholder, every other character kept."""
    if not text:
        return text
    out, at = [], 0
    for _, _, kind, parts in find(text):
        for i, (a, b) in enumerate(parts):
            out.append(text[at:a])
            if i == 0:
                out.append(f"REDACTED_{kind.upper()}")
            at = b
    return "".join(out) + text[at:]


SPAN = "array<struct<start:long,stop:long,line_no:long,kind:string>>"


def spans_column(text: str | Column) -> Column:
    """Spans of each text: 0-based start, stop (exclusive), line and kind."""

    @F.pandas_udf(SPAN)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows = []
            for t in s:
                line = pos = 0
                out = []
                for a, b, kind, _ in find(t):
                    line += t.count("\n", pos, a)
                    pos = a
                    out.append({"start": a, "stop": b, "line_no": line + 1, "kind": kind})
                rows.append(out)
            yield pd.Series(rows)

    return found(text)


def masked_column(text: str | Column) -> Column:
    """Masked texts."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([mask(t) for t in s], dtype="object")

    return masked(text)


def found_lines(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids.., line_no, kind, start, stop: one row per credential."""
    return df.select(*ids, F.explode(spans_column(text)).alias("s")).select(*ids, "s.line_no", "s.kind", "s.start", "s.stop")
