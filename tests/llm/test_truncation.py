import os
import random

import pytest

from codeloom.llm.truncation import Words, field_limits, split_sign, truncated, word_before

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a", 1), (2, "", None, 1), (3, "   ", "a", 1), (4, "short", "a", 1)], "doc_id long, text string, source string, n int")
    assert {(r.doc_id, r.is_cut) for r in truncated(df, "doc_id", "text", "source").collect()} <= {(i, False) for i in range(1, 5)}
    assert truncated(df.limit(0), "doc_id", "text", "source").count() == 0


def test_limits(spark):
    rows = [("a", 100 if i % 3 == 0 else 50 + i, f"t{i}") for i in range(60)] + [("b", 33, "same")] * 50
    df = spark.createDataFrame(rows, "source string, n int, text string")
    assert [(r.source, r.n) for r in field_limits(df.distinct()).collect()] == [("a", 100)]


def test_signs_and_words():
    assert split_sign("and so it goes ...") == ("and so it goes", "...") and split_sign("a b (+123 chars)") == ("a b", "(+0 chars)")
    assert split_sign("see f(x)") == ("see f(x)", "") and split_sign("done.") == ("done.", "") and split_sign("x" * 100_000 + " [more] ")[1] == "[more]"
    assert word_before("the " + "q" * 500) == "q" * 500 and word_before("一个代理") == "代理" and word_before("x = (") == "("
    w = Words()
    w.add("Plain line\nOne two. Three four\n```\ncode here\n```\nlast words")
    f = w.frame().set_index("word")
    assert f.loc["line"].p_ends == 1 and f.loc["two"].s_ends == 1 and f.loc["three"].s_inner == 1 and f.loc["four"].s_ends == 1 and f.loc["words"].d_ends == 1 and "code" not in f.index


def test_closing_forms_tell_idioms_and_signatures(spark):
    rnd = random.Random(5)
    def body():
        return " ".join(f"The {rnd.choice('abcdefgh')}{rnd.randrange(99)} item goes to place {rnd.randrange(999)}." for _ in range(3))
    rows = [(i, body() + (" And so on..." if i % 5 == 0 else f"\nThe {rnd.choice(['red', 'blue', 'green', 'grey'])}{rnd.randrange(9)} desk" if i % 5 == 1 else "")) for i in range(400)]
    cut = [(1000 + i, body()[: -rnd.randrange(6, 60)] + ("..." if i % 2 else "")) for i in range(16)]
    got = {r.doc_id: r.is_cut for r in truncated(spark.createDataFrame(rows + cut, "doc_id long, text string").selectExpr("*", "'a' as source"), "doc_id", "text", "source").collect()}
    assert sum(got[i] for i, _ in rows) <= 8 and sum(got[i] for i, _ in cut) >= 14


@pytest.mark.skipif(not os.path.exists(DOCS), reason="test tables are not here")
def test_held_out_accuracy(spark):
    """Texts that end as whole ones do stay whole; cut copies of other texts are found."""
    rnd = random.Random(3)
    docs = spark.read.parquet(DOCS).select("doc_id", "text", "source")
    whole = [r for r in docs.where("length(text) > 80 and (text like '%.' or text like '%!')").collect() if r.text[-2].isalpha()]
    made = []
    for i, r in enumerate(rnd.sample(whole, 150)):
        k = rnd.randrange(40, len(r.text) - 5)
        while r.text[k - 1] in ".!?\n)`" or r.text[k] in ".!?\n":
            k -= 1
        made.append((10_000_000 + i, r.text[:k], r.source))
    got = {r.doc_id: r.is_cut for r in truncated(docs.unionByName(spark.createDataFrame(made, docs.schema)), "doc_id", "text", "source").collect()}
    assert sum(got[x[0]] for x in made) >= 0.95 * len(made)
    assert sum(not got[r.doc_id] for r in whole) >= 0.97 * len(whole)


def test_copies_do_not_vouch_for_each_other(spark):
    """A cut text in a third of the rows is still cut."""
    rnd = random.Random(4)
    noun, verb, rest = ["river", "engine", "teacher", "market", "garden", "letter"], ["moves", "finds", "keeps", "leaves", "carries"], ["the old house", "a small boat", "its own way", "every stone", "the last train"]

    def sentence():
        return f"The {rnd.choice(noun)} {rnd.choice(verb)} {rnd.choice(rest)} near the {rnd.choice(noun)}."

    whole = list(dict.fromkeys(" ".join(sentence() for _ in range(rnd.randrange(2, 6))) for _ in range(400)))
    cut = sentence() + " The teacher carries the old house near the gard"
    rows = [(i, x, "a") for i, x in enumerate(whole + [cut] * (len(whole) // 2))]
    got = truncated(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()
    assert {r.is_cut for r in got if r.doc_id >= len(whole)} == {True}
    assert sum(not r.is_cut for r in got if r.doc_id < len(whole)) >= 0.97 * len(whole)
