"""The n-gram Jaccard join against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftplane.llm import jaccard


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def sets(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    found = {i: sets(t) for i, t in rows}
    parent = {i: i for i in found}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(found)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = found[a], found[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(found[i]), top(i)) for i in ids}


def near_copies(seed=0):
    """A family of near copies around the threshold, copies, shared passages, short texts."""
    r = np.random.default_rng(seed)
    word = lambda: "w" + str(r.integers(3000))
    base = [word() for _ in range(80)]
    passage = " ".join(word() for _ in range(30))
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(int(r.integers(0, 5))):
            w[int(r.integers(len(w)))] = word()
        rows.append(" ".join(w[int(r.integers(0, 4)) :]))
    rows += [passage + " " + " ".join(word() for _ in range(int(r.integers(0, 40)))) for _ in range(25)]
    rows += [" ".join(word() for _ in range(40)) for _ in range(10)]
    rows += [rows[70], rows[70].upper(), "", "  \n", None, "one", "ONE", "a b c d", "a b c d", "a b c d e", "a b c d e f g h", "a b c d e f g h i", "x " * 3000]
    return list(enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"frequent": 1}, {"frequent": 3}, {"frequent": 3, "stars": 0}, {"frequent": 2, "max_frequent": 10}])
def test_equals_brute_force(spark, options):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.join(df, **options).collect()}
    assert got == brute(rows)


def test_signatures_meet():
    """Linked sets share a signature that the rank and role rules keep."""
    r = np.random.default_rng(5)
    met = 0
    for _ in range(3000):
        n = int(r.integers(4, 150))
        common = np.sort(r.choice(2**40, n, replace=False).astype(np.uint64))
        x = np.sort(np.concatenate([common, r.choice(2**40, int(r.integers(0, n // 8 + 2)), replace=False).astype(np.uint64)]))
        y = np.sort(np.concatenate([common, r.choice(2**40, int(r.integers(0, n // 8 + 2)), replace=False).astype(np.uint64)]))
        if not jaccard.linked(len(x), len(y), n) or len(x) < 4 or len(y) < 4:
            continue
        p = r.choice([0.0, 0.3, 0.9, 1.0])
        rare = lambda g: ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(float) / 2**24 >= p  # noqa: B023, E731
        signed = []
        for g in (x, y):
            keep = rare(g)
            e = int(jaccard.errors(np.array([len(g)]))[0])
            if keep.sum() > e:
                k = g[keep][: e + 1]
                signed.append({int(a): (i, 0, 0, 0, 0) for i, a in enumerate(k)})
            else:
                k, info, more = jaccard.signatures(g, ~keep)
                signed.append({int(a): (int(i) >> 32, (int(i) >> 1) & (2**30 - 1), int(i) & 1, int(m) >> 32, int(m) & (2**32 - 1)) for a, i, m in zip(k, info, more, strict=True)})
        ex, ey = jaccard.missing(len(x), len(y)), jaccard.missing(len(y), len(x))

        def counts(k):
            (a1, b1, kind, c1, o1), (a2, b2, _, c2, o2) = signed[0][k], signed[1][k]  # noqa: B023
            spare = ex - a1 + ey - a2 + 1  # noqa: B023
            level = b1 < spare and b2 < spare and (o1 < spare if c1 >= spare else o2 < spare if c2 >= spare else False)
            return a1 <= ex and a2 <= ey and (kind == 0 or level)  # noqa: B023

        assert any(counts(k) for k in signed[0].keys() & signed[1].keys())
        met += 1
    assert met > 500


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(1)
    texts = [" ".join("w" + str(r.integers(50)) for _ in range(int(r.integers(5, 3000)))) for _ in range(20)]
    s = jaccard.Sets(texts, 5)
    maps = s.bitmaps()
    parts = [set(s.g[a:b].tolist()) for a, b in zip(s.lo[:-1], s.lo[1:], strict=True)]
    for i in range(20):
        for j in range(i):
            assert jaccard.differ_at_least(maps[i], maps[j]) <= len(parts[i] ^ parts[j])


def test_edges(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("node", T.LongType())])
    t = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, t, "x", 1), (1, t, "x", 1), (2, t, None, None), (None, t, None, None), (3, None, None, None)], schema)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=str)
    assert got == sorted([(1, 6, 1), (1, 6, 1), (2, 6, 1), (None, 6, None), (3, 0, 3)], key=str)
    assert jaccard.join(df.limit(0)).count() == 0


def test_stage_tells_rows_by_id_and_text(spark):
    long = lambda w, n=60: " ".join(f"{w}{i}" for i in range(n))
    rows = [(1, long("a")), (2, long("a")), (2, long("b")), (3, long("c")), (3, long("c")), (None, long("a")), (None, long("d")), (None, long("d")), (4, None), (4, None), (5, ""), (6, long("a") + " tail")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    for c in ("k", "row", "id", "node", "n", "z", "component_id"):
        docs = docs.withColumn(c, F.lit(1))
    out = jaccard.stage(spark, docs.repartition(3), "")
    assert out.columns == docs.columns
    got = sorted([(r.doc_id, r.text) for r in out.collect()], key=str)
    assert got == sorted([(1, long("a")), (2, long("b")), (3, long("c")), (None, long("d")), (4, None), (5, "")], key=str)
    assert jaccard.stage(spark, docs.limit(0), "").count() == 0


def test_links_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(500)
    rows = docs.select("doc_id", "text").collect()
    own = {r.doc_id: sets(r.text) for r in rows}
    by = {}
    for i, s in own.items():
        by.setdefault(frozenset(s), []).append(i)
    keys = [k for k in by if k]
    want = {k: 0 for k in keys}
    for x in range(len(keys)):
        for y in range(x):
            both = len(keys[x] & keys[y])
            if 100 * both >= 80 * len(keys[x] | keys[y]):
                want[keys[x]] += 1
                want[keys[y]] += 1
    found, member = jaccard.Join(spark.createDataFrame(rows), frequent=8).links()
    assert found.count() == sum(want.values()) // 2 > 0
    for r in member.collect():
        k = frozenset(own[r.id])
        assert (r.copies, r.links) == ((len(by[k]), want[k]) if k else (0, 0))
