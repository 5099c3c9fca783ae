"""Token counts of long texts against the tokenizer applied to the whole text."""

import random

import pytest

from codeloom.llm.queries import VOCABULARY
from codeloom.llm.tokens import STRETCH, count_tokens, encoder

ALPHABETS = ["abcdefgh ", "abcXYZ0189+/", "a  \n\t", "=-_ '", "日本語文字。 ", "x'sy'll 9  ", "a b c d e f\n\n   ", "é ü ñ'd "]


def generated(seed: int) -> str:
    rnd = random.Random(seed)
    out, want = [], rnd.choice([10, STRETCH - 1, STRETCH, STRETCH + 1, 70_000, 120_000, 200_000])
    while sum(map(len, out)) < want:
        out.append("".join(rnd.choices(rnd.choice(ALPHABETS), k=rnd.choice([50, 5000, 60_000]))))
    return "".join(out)[:want]


@pytest.mark.parametrize("part", range(8))
def test_counts_equal_the_tokenizer(part):
    enc = encoder(VOCABULARY)
    for seed in range(part * 25, part * 25 + 25):
        t = generated(seed)
        assert count_tokens(t, VOCABULARY) == len(enc.encode_ordinary(t)), seed


def test_runs_without_a_cut():
    enc = encoder(VOCABULARY)
    for t in ("ab1" * 60_000, " " * 80_000 + "x", "=" * 90_000, "word " * 30_000, "a" * STRETCH + " " * STRETCH + "'s"):
        assert count_tokens(t, VOCABULARY) == len(enc.encode_ordinary(t))
    assert count_tokens(" " * 1_000_000, VOCABULARY) > 0  # too long a run for the tokenizer's own pattern
    assert count_tokens(None, VOCABULARY) == count_tokens("", VOCABULARY) == 0
