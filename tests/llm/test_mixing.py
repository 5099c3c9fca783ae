
from codeloom.llm.mixing import mixture, plan_budgets


def frames(spark):
    rows = [(i, "big", 10, 1) for i in range(1000)] + [(2000 + i, "small", 7, 1) for i in range(20)] + [(3000, None, 5, 1), (3001, "other", 5, 1), (3002, "small", 0, 1), (3003, "small", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int, tokens int")
    targets = spark.createDataFrame([("big", 0.75, 1), ("small", 0.25, 3), ("absent", 0.1, 2), (None, 0.2, 1), ("off", None, 1)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_shares_as_near_as_repeats_allow(spark):
    docs, targets = frames(spark)
    rows, report = mixture(docs, targets, "doc_id", "source", "n_tokens", extent="exact")
    rep = {r.source: r for r in report.collect()}
    assert rep["small"].tokens_used == 20 * 7 * 3 and rep["small"].most_copies == 3
    assert abs(rep["big"].share_reached - 0.75) < 0.01 and abs(rep["big"].tokens_used - 1260) <= 5
    assert rep["absent"].tokens_used == 0 and rep["off"].tokens_used == 0
    used = rows.collect()
    assert {r.source for r in used} == {"big", "small"} and all(r.n_tokens > 0 for r in used)
    assert sum(r.n_tokens * r.copies for r in used) == sum(r.tokens_used for r in rep.values())
    assert len({r.doc_id for r in used}) == len(used)


def test_given_total_and_repeats(spark):
    docs, targets = frames(spark)
    _, report = mixture(docs, targets, "doc_id", "source", "n_tokens", total=4000.0)
    rep = {r.source: r for r in report.collect()}
    assert rep["big"].tokens_used == 3000 and rep["small"].tokens_used == 420


def test_as_large_as_all_records(spark):
    docs, targets = frames(spark)
    _, report = mixture(docs, targets, "doc_id", "source", "n_tokens")
    rep = {r.source: r for r in report.collect()}
    assert rep["big"].budget == 7605.0 and abs(rep["big"].tokens_used - 7605) <= 5 and rep["small"].tokens_used == 420 and rep["small"].most_copies == 3


def test_edges(spark):
    docs, targets = frames(spark)
    assert mixture(docs.limit(0), targets, "doc_id", "source", "n_tokens")[0].count() == 0
    assert mixture(docs, targets.limit(0), "doc_id", "source", "n_tokens")[0].count() == 0
    assert plan_budgets([], None) == ({}, 0.0)
