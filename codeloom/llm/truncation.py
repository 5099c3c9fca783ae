"""Detect texts that lost their end: hashed logistic regression trained on artificial cuts of intact texts.

Every different text of a source is read once. That pass gives corpus statistics over all texts: per word, how often it
occurs, within texts and at the end of a text, line or clause; per form of a closing sentence or line (its first and
last word and its length), how many texts close with it; per source, the lengths that far more texts have than their
neighbours do (field limits). It also gives each text's categories: closing character, sign of a cut, open fences, quotes
and brackets, kind and length of the last line, how well the last word and the closing form are known and how often
they end something, length at a limit, and their pairs with the source, hashed to a fixed number of weights. A bounded
sample of texts, taken by hash of the text, gives the training rows: as they are (negatives) and cut at random places
or at limits (positives). Some of the sample are cut themselves: a first fit on two halves finds the rows that the fit
on the other half holds for cut, and the last fit leaves these out; no row of the data is ever taken as a positive.
Every text is scored with the fitted weights.

Defined results
- A null or blank text, or one of fewer than ``min_chars`` characters, is not cut: probability 0.
- A null source is a source of its own. Repeated texts count once per source in the statistics and in the sample and get
  equal scores; all parts of a text fall in one half. Extra columns are ignored; an empty table gives an empty result.
- Sample size, hash size and seed are parameters; statistics, limits and scores cover all rows.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import Scratch

DIMS = 1 << 14
#: Different texts in the training sample at most, cuts made of each, and the share of weight that cuts have.
SAMPLE, COPIES, CUT_SHARE = 8_000, 6, 0.4
#: Texts a batch of the corpus pass may count words of before it hands them on.
WORDS_HELD = 200_000

BRACKETED = re.compile(r"\[(?:\.\.\.|…|more|cut|snip|truncated|\+\d+[^\]]*)\]|\((?:\+\d+ (?:chars|characters|more)|more|truncated|cut)\)|<(?:snip|truncated|cut)>", re.I)
WORD = re.compile(r"[^\W_][\w'’-]*")
LINE_ENDS = re.compile(r"[^\W_][\w'’-]*(?=[ `)*_\"']*\n)")
CLAUSE_ENDS = re.compile(r"[^\W_][\w'’-]*(?=[.!?,;:)。！？，；：]|[ `)*_\"']*\n)")
STOP = re.compile(r"[.!?。！？](?:\s|$)|[。！？]")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
SENTENCE_END = ".!?。！？"
CLAUSE_END = ".!?,;:)。！？，；："
CLOSERS = ")]}\"'`»”’）」』>*_"
SEGMENT = re.compile(r".*[.!?。！？，；：、](?=\s|[^\x00-\x7f])\s*", re.S)
BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s")
LINK = re.compile(r"(?:https?://|www\.)\S+$")
COUNTS = ["p_inner", "p_ends", "s_inner", "s_ends", "d_ends"]


def split_sign(text: str) -> tuple[str, str]:
    """(the text without a sign of a cut at its end, the sign)."""
    t = text.rstrip()
    if t.endswith(("…", "...", "�")):
        body = t.rstrip(t[-1])
        return body.rstrip(), {"…": "…", ".": "...", "�": "�"}[t[-1]]
    if t.endswith((")", "]", ">")):
        at = t.rfind({")": "(", "]": "[", ">": "<"}[t[-1]])
        if at >= 0 and BRACKETED.fullmatch(t, at):
            return t[:at].rstrip(), re.sub(r"\d+", "0", t[at:].lower())
    return text, ""


def word_before(body: str) -> str:
    """The last word of a text, or its last character if that is no part of a word; of unspaced script, the last two."""
    if CJK.match(body[-1:]):
        return body[-2:]
    at = len(body)
    while at > 0 and (body[at - 1].isalnum() or body[at - 1] in "_'’-"):
        at -= 1
    m = WORD.search(body, at)
    return m[0].lower() if m else body.strip()[-1:]


def closing_form(body: str, sign: str) -> str:
    """First and last word and number of words of the last sentence, or of the last line if that is shorter."""
    line = body[body.rfind("\n") + 1 :].strip()
    rest = line[SEGMENT.match(line).end() :] if SEGMENT.match(line) else line
    words = (rest or line).lower().split()
    return f"{words[0]}|{words[-1]}|{min(len(words), 8)}|{sign}" if words else sign


def end_class(c: str) -> str:
    if not c:
        return "none"
    if c in SENTENCE_END:
        return "stop"
    if c.isspace():
        return "space"
    if c in CLOSERS:
        return "close" + c
    if c in ",;:，；：、":
        return "comma"
    if CJK.match(c):
        return "cjk"
    if c.isdigit():
        return "digit"
    return "letter" if c.isalpha() else "sign"


def line_kind(line: str, fenced: bool) -> str:
    if fenced:
        return "code"
    s = line.strip()
    if s.startswith("#"):
        return "heading"
    if s.startswith("```"):
        return "fence"
    if LINK.search(s):
        return "link"
    if BULLET.match(line):
        return "bullet"
    if re.match(r"[\w-]+: ", s):
        return "labelled"
    return "text"


def described(text: str, source: str, dims: int) -> tuple[str, int, list[str], list[int]]:
    """(last word, hash of the closing form, the parts that are crossed with statistics, hashed categories without)."""
    body, sign = split_sign(text)
    end = end_class(body[-1:])
    fenced = body.count("```") % 2 == 1
    line = body[body.rfind("\n") + 1 :]
    kind = line_kind(line, fenced)
    para = body[body.rfind("\n\n") + 1 :] if not fenced else line
    ticks = "ticks" if not fenced and para.replace("```", "").count("`") % 2 else ""
    braces = "open" if para.count("(") > para.count(")") or para.count("[") > para.count("]") or para.count("（") > para.count("）") else ""
    quotes = "quotes" if para.count('"') % 2 else ""
    words = len(line.split())
    length = str(words if words < 8 else 8 + min(words // 8, 4))
    whole = "sentences" if STOP.search(line) else "phrase"
    lines = "lines" if "\n" in body else "line"
    cats = [f"src={source}", f"end={end}", f"sign={sign}", f"fence={fenced}", f"ticks={ticks}", f"open={braces}", f"quotes={quotes}", f"kind={kind}", f"len={length}", f"whole={whole}", "bias"]
    cats += [f"{source}|{end}", f"{source}|{kind}|{end}", f"{kind}|{end}|{whole}", f"{fenced}|{end}", f"{source}|{whole}|{length}", f"{sign}|{end}", f"{source}|{fenced}", f"{lines}|{source}|{end}|{whole}", f"{lines}|{length}|{kind}|{end}"]
    return word_before(body), zlib.crc32(closing_form(body, sign).encode()), [source, end, sign, kind, whole], hashed(cats, dims)


def levels(inner: float, ends: float) -> tuple[str, str]:
    """Categories of how often a word occurs and how often it ends something."""
    n = inner + ends
    known = str(0 if n < 1 else 1 if n < 3 else 2 if n < 10 else 3 if n < 50 else 4)
    p = ends / n if n else -1.0
    return known, str(-1 if p < 0 else 0 if p < 0.003 else 1 if p < 0.02 else 2 if p < 0.06 else 3 if p < 0.2 else 4 if p < 0.6 else 5)


def crossed(keys: list[str], stats: tuple[float, ...], forms: float, at_limit: bool) -> list[str]:
    """Categories with statistics: the last word's counts (COUNTS) and how many other texts close in the same form."""
    p_inner, p_ends, s_inner, s_ends, d_ends = stats
    src, end, sign, kind, whole = keys
    known, level = levels(p_inner, p_ends) if whole == "phrase" else levels(s_inner, s_ends)
    any_known, _ = levels(p_inner + s_inner, p_ends + s_ends)
    _, closes = levels(p_inner + p_ends, max(0.0, d_ends))
    known, lim, w = whole[0] + known, "lim" + str(int(at_limit)), whole[0]
    form = "form" + str(0 if forms < 1 else 1 if forms < 3 else 2 if forms < 10 else 3)
    return [f"k={known}", f"{w}l={level}", lim, "any" + any_known, f"{known}|{level}", f"{known}|{level}|{end}", f"{w}{level}|{src}", f"{known}|{end}", f"{w}{level}|{kind}|{end}", f"{lim}|{end}", f"{lim}|{w}{level}", f"{known}|{level}|{kind}|{end}", f"any{any_known}|{end}", f"c{closes}|{w}|{kind}|{end}", form, f"{form}|{end}", f"{form}|{sign}|{end}", f"{form}|{w}{level}"]


def hashed(cats: list[str], dims: int) -> list[int]:
    return sorted({zlib.crc32(c.encode()) % dims for c in cats})


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, dims: int, epochs: int = 300, l2: float = 2e-4) -> np.ndarray:
    """Weights of a logistic regression over sets of active features (full-batch Adam)."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, ix = np.unique(np.concatenate(rows), return_inverse=True)  # only these weights ever move
    k = len(used)
    w, m, v = np.zeros(k), np.zeros(k), np.zeros(k)
    n = weight / weight.sum()
    for t in range(1, epochs + 1):
        z = np.bincount(at, w[ix], len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * n
        grad = np.bincount(ix, g[at], k) + l2 * w / 10
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(dims)
    out[used] = w
    return out


def score(rows: list[list[int]], w: np.ndarray) -> np.ndarray:
    return np.array([1 / (1 + np.exp(-np.clip(w[r].sum(), -30, 30))) for r in rows]) if rows else np.zeros(0)


def cuts(text: str, seed: int, n: int, limit: int | None) -> list[str]:
    """Beginnings of a text that do not end a sentence or line, some with a sign of the cut, some at ``limit``."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        if len(text) < 16:
            break
        k = limit if limit and 12 < limit < len(text) and rnd.random() < 0.3 else rnd.randrange(12, len(text) - 1)
        part, nxt = text[:k], text[k]
        if part[-1] in SENTENCE_END or nxt == "\n" or part[-1] == "\n" or (part[-1] in CLOSERS and nxt in " \n") or part.endswith("```"):
            continue
        r = rnd.random()
        out.append(part + ("..." if r < 0.06 else "…" if r < 0.12 else " [...]" if r < 0.15 else " [more]" if r < 0.18 else f" (+{rnd.randrange(5, 999)} chars)" if r < 0.21 else ""))
    return out


class Words:
    """Counts of words: in lines without sentence punctuation, inside (p_inner) and at the end of a line that is not the
    text's last (p_ends); in other lines, inside (s_inner) and before punctuation or the line's end (s_ends); at the end
    of a text (d_ends). Lines of code are left out. Unspaced script counts by pairs of characters."""

    def __init__(self) -> None:
        self.n = [Counter() for _ in COUNTS]

    def add(self, text: str) -> None:
        low = text.lower()
        plain: list[str] = []
        clauses: list[str] = []
        fenced = False
        lines = low.split("\n")
        for i, line in enumerate(lines):
            if line.lstrip().startswith("```"):
                fenced = not fenced
            elif not fenced:
                last = i == len(lines) - 1
                kind = 2 if STOP.search(line) else 0
                if last or CJK.search(line):
                    self._line(line, kind, last)
                else:
                    (clauses if kind else plain).append(line)
        for base, part, ends in ((0, plain, LINE_ENDS), (2, clauses, CLAUSE_ENDS)):
            if part:
                joined = "\n".join(part) + "\n"
                closing = Counter(ends.findall(joined))
                self.n[base].update(WORD.findall(joined))
                self.n[base].subtract(closing)
                self.n[base + 1].update(closing)

    def _line(self, line: str, base: int, last: bool) -> None:
        for m in WORD.finditer(line):
            w, e = m[0], m.end()
            if CJK.search(w):
                for j in range(len(w) - 1):
                    self.n[base][w[j : j + 2]] += 1
                w = w[-2:]
            if not line[e:].strip(" `)*_\"'"):
                self.n[4 if last else base + 1][w] += 1
            else:
                self.n[base + 1 if base and line[e] in CLAUSE_END else base][w] += 1

    def frame(self) -> pd.DataFrame:
        f = pd.DataFrame({c: pd.Series(n, dtype="float64") for c, n in zip(COUNTS, self.n)}).fillna(0)
        f = f[(f != 0).any(axis=1)]
        f.insert(0, "word", f.index.astype(str))
        self.__init__()
        return f.reset_index(drop=True)


READ = "kind int, word string, " + ", ".join(f"{c} double" for c in COUNTS) + ", key long, source string, n int, form long, parts array<string>, cats array<int>"


def read(texts: DataFrame, dims: int) -> DataFrame:
    """One pass over (source, text, key, n): rows of kind 0 with counts of words, and of kind 1 with a text's categories."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        names = ["word", "form", "parts", "cats"]
        for pdf in batches:
            got = pd.DataFrame([described(t, s, dims) for t, s in zip(pdf["text"], pdf["source"])], columns=names)
            for t, once in zip(pdf["text"], pdf["once"]):
                if once:
                    words.add(t)
            yield _rows(pdf[["key", "source", "n"]].reset_index(drop=True).join(got).assign(kind=1))
            if max(map(len, words.n)) > WORDS_HELD:
                yield _rows(words.frame().assign(kind=0))
        yield _rows(words.frame().assign(kind=0))

    return texts.select("source", "text", "key", "n", "once").mapInPandas(run, READ)


def _rows(f: pd.DataFrame) -> pd.DataFrame:
    names = [x.strip().split(" ")[0] for x in READ.split(", ")]
    absent = {c: pd.Series([None] * len(f), dtype="object", index=f.index) for c in ("word", "source", "parts", "cats") if c not in f}
    f = f.assign(**absent).reindex(columns=names)
    for c in ("key", "form", "n", "kind"):
        f[c] = f[c].astype("Int64")
    return f


def described_column(text: Column, source: Column, dims: int) -> Column:
    """word, form, parts and cats of a text as a struct."""

    @F.pandas_udf("struct<word:string,form:long,parts:array<string>,cats:array<int>>")
    def one(t: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([described(x, y, dims) for x, y in zip(t, s)], columns=["word", "form", "parts", "cats"])

    return one(text, source)


def looked_up(rows: DataFrame, facts: DataFrame, on: list[str], scratch: Scratch, total: int, share: int = 10_000) -> DataFrame:
    """``rows`` left joined with ``facts`` (unique ``on``). Keys that a ``share``-th of the rows have, at most ``share``
    of them, meet their facts by broadcast, so that no task gets all rows of a common key."""
    hot = scratch.write(rows.groupBy(*on).agg(F.count("*").alias("_c")).where(F.col("_c") * share >= total).select(*on))
    hot = F.broadcast(hot)
    common = F.broadcast(hot.join(facts, on, "left"))
    return rows.join(common, on).unionByName(rows.join(hot, on, "left_anti").join(facts, on, "left"))


def field_limits(texts: DataFrame, least: int = 4, ratio: float = 6.0, near: int = 12) -> DataFrame:
    """(source, n): lengths that at least ``least`` different texts of a source have and far more than their neighbours."""
    h = texts.groupBy("source", "n").agg(F.count("*").alias("c"))
    span = f"sum(c) over (partition by source order by n range between {near} preceding and {near} following)"
    h = h.withColumn("around", (F.expr(span) - F.col("c")) / (2 * near))
    return h.where((F.col("c") >= least) & (F.col("c") >= ratio * F.greatest(F.col("around"), F.lit(0.25)))).select("source", "n")


FACTS = ["parts", "cats", "forms", *COUNTS, "at_limit"]


def features(own: bool, limits: bool, dims: int) -> Column:
    """All hashed categories of a row of FACTS; ``own`` texts are in the statistics themselves and are taken out of them,
    ``limits`` shows whether the length is at a limit."""

    @F.pandas_udf("array<int>")
    def made(parts: pd.Series, cats: pd.Series, forms: pd.Series, stats: pd.DataFrame, at: pd.Series) -> pd.Series:
        o = int(own)
        rows = zip(parts, cats, forms, stats.itertuples(index=False, name=None), at)
        return pd.Series([sorted({*c.tolist(), *hashed(crossed(list(p), (*s[:4], s[4] - o), f - o, limits and bool(a)), dims)}) for p, c, f, s, a in rows], dtype="object")

    return made("parts", "cats", "forms", F.struct(*COUNTS), "at_limit")


def train(rows: pd.DataFrame, dims: int, cut_share: float = CUT_SHARE, rounds: int = 3, doubt: float = 0.3) -> np.ndarray:
    """Weights from training rows: y (1 for artificial cuts), half, at_limit, plain and full (features without and with
    limits), and c, how many rows are the same."""
    y, half, c = rows["y"].to_numpy(), rows["half"].to_numpy(), rows["c"].to_numpy().astype(float)
    plain, full = rows["plain"].tolist(), rows["full"].tolist()

    def fitted(feats: list, use: np.ndarray, epochs: int) -> np.ndarray:
        at = np.flatnonzero(use)
        cut, n = y[at] == 1, c[at]
        weight = n * np.where(cut, cut_share / max(1, n[cut].sum()), (1 - cut_share) / max(1, n[~cut].sum())) * len(y)
        return fit([feats[i] for i in at], cut.astype(float), weight, dims, epochs)

    # rows of the data may be cut themselves: negatives that the other half's fit doubts are left out; it does not see
    # which lengths are at a limit, since all rows there are left out at first
    out = rows["at_limit"].to_numpy() & (y == 0)
    for _ in range(rounds):
        nxt = np.zeros(len(rows), dtype=bool)
        for h in (0, 1):
            at = np.flatnonzero((half == h) & (y == 0))
            if len(at) and ((half != h) & ~out).any():
                nxt[at] = score([plain[i] for i in at], fitted(plain, (half != h) & ~out, 120)) > doubt
        out = nxt
    return fitted(full, ~out, 300)


def truncated(df: DataFrame, record_id: str, text: str, source: str, min_chars: int = 12, sample: int = SAMPLE, dims: int = DIMS, seed: int = 11, copies: int = COPIES) -> DataFrame:
    """record_id, source, probability, is_cut, at_limit of every row."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    docs = df.select(F.col(record_id).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    live = docs.where(F.length(F.trim("text")) >= min_chars).withColumn("n", F.length("text")).withColumn("key", F.xxhash64(F.lit(seed), "text"))
    # each different text of a source once; one of the sources of a text counts its words
    different = live.groupBy("key", "text", "n").agg(F.sort_array(F.collect_set("source")).alias("s")).select("key", "text", "n", F.posexplode("s").alias("i", "source")).withColumn("once", F.col("i") == 0)
    passed = scratch.write(read(different, dims))
    texts = passed.where("kind = 1").select("key", "source", "n", "word", "form", "parts", "cats")
    total = texts.count()
    if not total:
        return docs.select(F.col("id").alias(record_id), F.when(F.col("source") != "", F.col("source")).alias(source), F.lit(0.0).alias("probability"), F.lit(False).alias("is_cut"), F.lit(False).alias("at_limit"))
    words = scratch.write(passed.where("kind = 0").groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    limits = scratch.write(field_limits(texts))
    forms = texts.groupBy("form").agg(F.countDistinct("key").alias("forms"))

    def with_facts(x: DataFrame, n: int) -> DataFrame:
        x = looked_up(x, words, ["word"], scratch, n)
        x = looked_up(x, forms, ["form"], scratch, n)
        x = looked_up(x, limits.withColumn("at_limit", F.lit(True)), ["source", "n"], scratch, n)
        return x.na.fill(0, [*COUNTS, "forms"]).na.fill(False, ["at_limit"])

    scored_rows = scratch.write(with_facts(texts, total).select("key", "source", "n", "parts", "cats", "forms", *COUNTS, "at_limit"))

    @F.pandas_udf("array<string>")
    def cut(t: pd.Series, k: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series([cuts(x, int(z), copies, None if pd.isna(m) else int(m)) for x, z, m in zip(t, k, limit)])

    # at most ``sample`` different texts, taken by hash, and what the pass found of them
    rate = min(1.0, 0.97 * sample / total)
    chosen = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("key")), F.lit(1_000_000)) < int(rate * 1_000_000)
    half = F.pmod("key", F.lit(2)).cast("int").alias("half")

    def rows(x: DataFrame, y: int) -> DataFrame:
        x = x.select("at_limit", F.lit(y).alias("y"), half, features(not y, False, dims).alias("plain"), features(not y, True, dims).alias("full"))
        return x.groupBy(*x.columns).agg(F.count("*").alias("c"))

    picked = scratch.write(live.where(chosen).select("source", "text", "n", "key").distinct().orderBy("key", "source").limit(sample))
    own = rows(scored_rows.join(F.broadcast(picked.select("source", "n", "key")), ["source", "n", "key"]), 0)
    inside = picked.select("source", "n", "key").join(limits.withColumnRenamed("n", "limit"), "source").where(F.col("limit") < F.col("n")).groupBy("source", "n", "key").agg(F.min_by("limit", F.xxhash64("limit", "key")).alias("limit"))
    made = picked.join(inside, ["source", "n", "key"], "left").select("source", "key", F.explode(cut("text", "key", "limit")).alias("text")).withColumn("n", F.length("text"))
    made = scratch.write(made.withColumn("d", described_column(F.col("text"), F.col("source"), dims)).select("source", "key", "n", "d.*"))
    made = rows(with_facts(made, sample), 1)
    w = train(own.unionByName(made).toPandas(), dims)  # at most sample * (1 + copies) rows of short lists

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(score(x.tolist(), w), dtype="float64")

    scores = scratch.write(scored_rows.select("key", "source", "n", F.round(scored(features(True, True, dims)), 6).alias("probability"), "at_limit"))
    all_rows = docs.withColumn("n", F.length("text")).withColumn("key", F.xxhash64(F.lit(seed), "text")).select("id", "source", "n", "key")
    both = looked_up(all_rows, scores, ["key", "source", "n"], scratch, total).na.fill(0.0, ["probability"]).na.fill(False, ["at_limit"])
    return both.select(F.col("id").alias(record_id), F.when(F.col("source") != "", F.col("source")).alias(source), "probability", (F.col("probability") >= 0.5).alias("is_cut"), "at_limit")
