"""Ranked search and source divergence against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from driftplane.llm import divergence, search

ODD = [None, "", "   \n", "!?", "é É", "\U0001f600", "x" * 5000, "word " * 5000, "Ünï ünï", "a1 A1 a-1"]


def zipf(r, n, size=400):
    return " ".join(f"w{int(size ** r.random())}" for _ in range(n))


def words(r, n, size=400):
    return " ".join("".join(chr(97 + int(d)) for d in str(int(size ** r.random()))) for _ in range(n))


def documents(r):
    texts = [zipf(r, r.choice([1, 5, 40, 300])) for _ in range(250)]
    return list(enumerate(texts + ODD + [texts[0]] * 30 + texts[5:20]))


def searched(spark, docs, items, k, parts=3):
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "row", "term", "n", "item", "score", "rank", "share")}).repartition(parts)
    asked = spark.createDataFrame(items, "item_id string, text string").withColumn("item", F.lit("x")).withColumn("term", F.lit(0))
    return sorted(map(tuple, search.rank(table, asked, k).select("item_id", "rank", "doc_id", "score").collect()))


def test_search_equals_scoring_every_document(spark, monkeypatch):
    r = random.Random(3)
    docs = documents(r)
    items = [(f"i{j}", t) for j, t in enumerate([zipf(r, r.choice([1, 3, 30])) for _ in range(25)] + ODD + [docs[0][1], "nothing known here", "w1 w1 w1 w2"])]
    for k in (1, 20):
        assert searched(spark, docs, items, k) == sorted(search.brute(docs, items, k))
    # beyond the bounds of broadcasts the same, by shuffles
    monkeypatch.setattr(search, "FEW", 3)
    assert searched(spark, docs, items[:12], 5, parts=2) == sorted(search.brute(docs, items[:12], 5))


def test_search_of_equal_scores_and_repeats(spark):
    docs = [(i, "alpha beta") for i in range(60)] + [(i, "gamma") for i in range(60, 90)]
    items = [("one", "Alpha"), ("one", "Alpha"), ("two", "alpha gamma gamma")]
    got = searched(spark, docs, items, 20)
    assert got == sorted(search.brute(docs, items[1:], 20))
    assert [x[2] for x in got if x[0] == "one"] == list(range(20))
    # rows of one id are documents of their own
    same = searched(spark, [(7, "alpha"), (7, "alpha"), (None, "alpha"), (8, "beta beta")], [("one", "alpha")], 20)
    assert [x[2] for x in same] == [None, 7, 7]


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [("a", "b")], 5) == []
    assert searched(spark, [(1, "b")], [], 5) == []
    assert searched(spark, [(1, None)], [("a", "b")], 5) == []


def test_pruning_keeps_what_it_must(spark):
    """A document that holds only frequent terms of an item, but all of them, is found."""
    docs = [(i, "the of and " * 3 + f"rare{i}") for i in range(40)] + [(100 + i, f"the x{i} y{i}") for i in range(200)]
    items = [("i", "the of and rare3 rare4 zzz")]
    assert searched(spark, docs, items, 20) == sorted(search.brute(docs, items, 20))


def audited(spark, rows, parts=3, **more):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "count", "item", "value", "p", "n", "v")}).repartition(parts)
    out = divergence.audit(docs, **more)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, out.collect()))


def corpus(r):
    rows = [(words(r, r.choice([3, 30, 200])), r.choice(["en", "de", None]), f"s{min(5, int(2 * r.expovariate(1)))}") for _ in range(300)]
    rows += [(t, "en", "s1") for t in ODD] + [(None, "xx", "alone"), ("", "yy", "a"), ("  ", "yy", "b"), ("once", "yy", None)]
    return rows + rows[:20]


def test_divergence_equals_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(4))
    for least in (30, 3):
        assert audited(spark, rows, least_docs=least, top=7) == sorted(divergence.brute(rows, least, 7))
    monkeypatch.setattr(divergence, "FEW", 2)
    monkeypatch.setattr(divergence, "SLICE_CHARS", 500)
    assert audited(spark, rows, parts=5, least_docs=10) == sorted(divergence.brute(rows, 10))


def test_divergence_edges(spark):
    assert audited(spark, []) == []
    assert audited(spark, [(None, None, None)]) == []
    assert audited(spark, [("a", "en", "x"), ("b", "en", "y")]) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shares_are_exact_at_any_size(spark):
    row = spark.createDataFrame([(9 * 10**12, 10**13, 10**6)], "c long, n long, v long").select(divergence._share("c", "n", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**12 + 5) // (10**13 + 5 * 10**6)


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_source_divergence"])
def test_queries_equal_sql(spark, name):
    import oracle
    from driftplane.llm import registry

    assert not oracle.compare(spark, "/root/testdata/sf0.01", registry.queries()[name], registry.oracle_sql()[name])
