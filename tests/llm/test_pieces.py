import random

import pytest

from codeloom.llm.pieces import items, split_oversized

SCHEMA = "id long, content string, lim int, ov int, piece_no int"


def texts():
    rnd = random.Random(2)
    code = "".join(f"def f{i}(x):\n" + "".join(f"    y{j} = x + {j}\n" for j in range(rnd.randrange(1, 8))) + "\n" for i in range(60))
    return [(1, code, 300, 40, 0), (2, code.replace("\n", "\r\n"), 200, 50, 0), (3, "x" * 1000, 90, 10, 0), (4, "字😀é " * 300, 77, 7, 0), (5, "a\n" * 500, 10, 9, 0), (6, "a b" * 50, 20, 0, 0), (7, "short", 300, 5, 0), (8, None, 5, 1, 0), (9, "", 5, 1, 0), (10, "x\n\n" * 400, 100, None, 0), (11, "ab" * 40, 3, 50, 0), (12, "x" * 20, None, 3, 0), (13, "exactly ten", 11, 2, 0)]


def test_pieces(spark):
    data = texts()
    rows = split_oversized(spark.createDataFrame(data, SCHEMA), ["id"], "content", "lim", "ov").collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append(r)
    assert set(got) == {i for i, t, n, *_ in data if t and n and len(t) > n}
    for i, text, lim, ov, _ in data:
        if i not in got:
            continue
        ps = sorted(got[i], key=lambda r: r.piece_no)
        assert [p.piece_no for p in ps] == list(range(len(ps))) and ps[0].n_pieces == len(ps)
        rebuilt, at = "", 0
        for p in ps:
            assert 0 < len(p.piece) == p.n_chars <= lim
            assert text[p.start - 1 : p.start - 1 + p.n_chars] == p.piece
            if p.piece_no:
                shared = at - (p.start - 1)
                assert shared == min(ov or 0, lim - 1, at)
            rebuilt += p.piece[at - (p.start - 1) :]
            at = p.start - 1 + p.n_chars
        assert rebuilt == text


def test_boundaries(spark):
    code = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(40))
    rows = split_oversized(spark.createDataFrame([(1, code, 100, 0, 0)], SCHEMA), ["id"], "content", "lim", "ov").orderBy("piece_no").collect()
    assert all(r.piece.startswith("def ") for r in rows)


def test_very_long_text(spark):
    text = "word " * 400_000
    rows = split_oversized(spark.createDataFrame([(1, text, 12000, 400, 0)], SCHEMA), ["id"], "content", "lim", "ov").selectExpr("count(*) n", "sum(n_chars) c", "max(n_chars) m").collect()[0]
    assert rows.m <= 12000 and rows.c == len(text) + (rows.n - 1) * 400


def test_items(spark):
    chunks = spark.createDataFrame([(1, "function", "a.py", "x" * 30), (2, None, None, "x" * 30), (3, "class", None, None)], "faiss_id long, chunk_type string, file_path string, content string")
    files = spark.createDataFrame([(1, "b/c.JSON", "y" * 30)], "sync_id long, path string, content string")
    limits = spark.createDataFrame([("chunk", "function", 10, 2), ("chunk", "function", 20, 2), ("file", None, 25, 3)], "item_kind string, chunk_type string, max_chars int, overlap_chars int")
    assert sorted((r.item_kind, r.item_id, r.max_chars, r.text_kind) for r in items(chunks, files, limits).collect()) == [("chunk", 1, 10, "member"), ("file", 1, 25, "data")]
    assert items(chunks.limit(0), files.limit(0), limits).count() == 0


def pieces(spark, text, lim, ov=0, kind="code"):
    df = spark.createDataFrame([(1, text, lim, ov, kind)], "id long, content string, lim int, ov int, kind string")
    return [r.piece for r in split_oversized(df, ["id"], "content", "lim", "ov", "kind").orderBy("piece_no").collect()]


@pytest.mark.parametrize("kind", ["code", "member", "data", "prose", "other", None])
def test_boundaries_anywhere_come_before_characters(spark, kind):
    assert pieces(spark, "short line\n" + "x" * 80, 90, 0, kind) == ["short line\n", "x" * 80]


def test_blank_lines_with_spaces_and_kinds(spark):
    block = "a = 1\nb = 2\nc = 3\n"
    assert pieces(spark, block + "   \t \n" + block, 30) == [block + "   \t \n", block]
    prose = "One two three four. Five six seven, eight nine ten. Eleven."
    assert pieces(spark, prose, 40, 0, "prose") == ["One two three four. ", "Five six seven, eight nine ten. Eleven."]
    method = "class A:\n    x = [1,\n        2]\n    def f(self):\n        return 1\n"
    assert pieces(spark, method, 50, 0, "member")[1].startswith("    def f") or pieces(spark, method, 50, 0, "member")[1].startswith("        return")


def test_empty(spark):
    assert split_oversized(spark.createDataFrame([], SCHEMA), ["id"], "content", "lim", "ov").count() == 0
