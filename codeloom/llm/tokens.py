"""Token counts of texts under a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the public pattern that splits text before the merges of a byte-level rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A longer text is encoded in stretches of about this many characters, cut only where the pattern cuts too.
STRETCH = 50_000


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a rank file, loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def splitter():
    """The pattern for runs that have no safe cut, with white space as the tokenizer knows it."""
    import regex

    return regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def safe_cut(text: str, at: int, end: int) -> int:
    """The last position in (at, end) where white space follows another character, or ``at``: no piece of the
    pattern goes on there, and none before it looks further, so that both sides are split as in the whole text."""
    for m in re.finditer(r"[ \n\t]", text[at + 1 : end][::-1]):
        k = end - 1 - m.start()
        if not text[k - 1].isspace():
            return k
    return at


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of a text; 0 for a null or empty one. The count is the tokenizer's for the whole text, however long."""
    if not text:
        return 0
    enc, n, at = encoder(path), 0, 0
    while len(text) - at > STRETCH:
        cut = safe_cut(text, at, at + STRETCH)
        if cut > at:
            n += len(enc.encode_ordinary(text[at:cut]))
            at = cut
            continue
        stop = at + STRETCH
        for m in splitter().finditer(text, at):  # one long run: piece by piece until past it
            n += len(enc._core_bpe.encode_single_piece(m[0].encode("utf-8", "replace")))  # noqa: SLF001
            at = m.end()
            if at >= stop:
                break
    return n + len(enc.encode_ordinary(text[at:]))


def n_tokens(text: Column, path: str) -> Column:
    """Column of token counts (long, never null) by the rank file at ``path``, which every worker can read."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([count_tokens(t, path) for t in s], dtype="int64")

    return counted(text)
