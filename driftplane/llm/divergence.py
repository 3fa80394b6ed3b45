"""Source divergence audit: how far the sources of a language differ in their words.

For two groups (a language's sources) the distance is the sum, over the language's kept
terms, of the difference of two smoothed shares, each a function of the term's count alone.
Few terms occur in a group, so the sum is put together by inclusion and exclusion over the
groups' supports:

* a term of one group is priced as if the other did not have it; that depends on the count
  only, so a histogram of counts a group (how many terms have which count) prices all terms
  of a group against another in one small join;
* terms that both groups have are found by a join of the sparse counts on the term, and what
  the histograms said wrongly of them is put right;
* terms that neither has differ by one constant, times their number.

The sum is the same integer as over all terms.  Documents are counted slice by slice in
numpy and added up in two steps, so a frequent term is a few rows a task; nothing of the
vocabulary is collected or broadcast unless counted to be few.

Edge cases: null text, lang and source count as ''; groups and languages without terms have
their rows; a language that keeps no term has distances 0; every row is a document, repeated
ones too; very long texts are counted whole; an empty table gives an empty result; other
columns are ignored.  Within a slice terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from . import text as tx

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Characters that are counted together in a task.
SLICE_CHARS = 1 << 20
#: Rows of a side of a join that are broadcast at most.
FEW = 500_000
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _is_letter(cp: np.ndarray) -> np.ndarray:
    return ((cp - np.uint32(97)) < 26) | (cp >= 128)


def tally(texts: list[str], group: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of the different terms of each group."""
    b = tx.Block(texts)
    low = tx.ascii_lower(b.cp)
    s, e, doc = b.runs(_is_letter(low))
    if not len(s):
        none = np.zeros(0, np.int64)
        return none, [], none, none
    h = tx.Hasher(low).spans(s, e)
    of = group[doc]
    order = np.lexsort((doc, h, of))
    h, of, doc, s, e = h[order], of[order], doc[order], s[order], e[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))
    fresh = new | np.concatenate(([True], doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    whole = low.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    terms = [whole[i:j] for i, j in zip(s[first].tolist(), e[first].tolist(), strict=True)]
    return of[first], terms, np.diff(np.append(first, len(h))), np.add.reduceat(fresh.astype(np.int64), first)


def group_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, count, docs) of every term of every group; a null term marks each
    group that occurs."""

    def run(batches):
        for batch in batches:
            for lo, hi in tx.slices(batch.column(2), SLICE_CHARS):
                part = batch.slice(lo, hi - lo)
                pairs = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                names = sorted(set(pairs))
                at = {p: i for i, p in enumerate(names)}
                of, terms, n, seen = tally(tx.texts_of(part.column(2)), np.array([at[p] for p in pairs]))
                rows = np.concatenate((np.arange(len(names)), of)).tolist()
                zero = np.zeros(len(names), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([names[i][0] for i in rows], pa.string()), pa.array([names[i][1] for i in rows], pa.string()), pa.array([None] * len(names) + terms, pa.string()), pa.array(np.concatenate((zero, n))), pa.array(np.concatenate((zero, seen)))], names=["lang", "source", "term", "count", "docs"])

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return store.keep(found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _share(count: str, total: str, kept: str) -> F.Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), exact at any size."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + {SMOOTH} as decimal(20,0))) div nullif(cast({total} + {SMOOTH} * {kept} as decimal(20,0)), 0)")


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank).  Part 'pair' has the distance of every group to
    each other source of its language; part 'term' has a group's ``top`` terms by how much
    more of the group they are than of the language."""
    store.bound_batches(docs.sparkSession)
    counted = group_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col)
    kept = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("count").alias("all")).where(F.col("d") >= least_docs).drop("d")
    kept = store.keep(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
    posts = store.keep(counted.where("term is not null").join(_few(kept), ["lang", "term"]).select("lang", "source", "term", "count", "all"), "posts")
    sizes = posts.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("held"))
    groups = counted.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(_few(langs), "lang", "left").fillna(0, ["n", "held", "v", "lang_n"])
    groups = store.keep(groups.withColumn("none", F.coalesce(_share("0", "n", "v"), F.lit(0).cast("long"))), "groups")
    known = _few(groups)
    priced = posts.join(known, ["lang", "source"]).withColumn("p", _share("count", "n", "v"))
    # one-sided: how many terms of a group have which share, against every other group's none
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    shares = store.keep(priced.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")), "histograms")
    sides = shares.join(_few(other), "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * F.abs(F.col("p") - F.col("other"))).alias("value"))
    sides = sides.unionByName(sides.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # overlaps: what both sides said, against what is so
    held = store.keep(priced.select("lang", "term", "source", "p", "none"), "shares")
    left, right = held, held.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("other"))
    mend = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("other")) - F.abs(F.col("none") - F.col("q")) + F.abs(F.col("none") - F.col("other"))
    both = left.join(right, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(mend).alias("value"))
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # terms that neither has: a constant; where both have a term, it is counted above
    empty = groups.join(_few(groups.select("lang", F.col("source").alias("item"), F.col("held").alias("other_held"), F.col("none").alias("other"))), "lang").where("source <> item")
    empty = empty.select("lang", "source", "item", ((F.col("v") - F.col("held") - F.col("other_held")) * F.abs(F.col("none") - F.col("other"))).alias("value"))
    pairs = sides.unionByName(both).unionByName(empty).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    terms = priced.withColumn("value", F.col("p") - _share("all", "lang_n", "v")).where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(place))
    terms = terms.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select(F.col("lang").alias(lang_col), F.col("source").alias(source_col), "part", "item", "value", "rank")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(store.table(spark, sf_dir, "documents"))


_TERMS = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
_SHARE = f"CASE WHEN {{0}} + {SMOOTH} * {{1}} = 0 THEN 0 ELSE 1 + ({SCALE}::HUGEINT * ({{2}} + {SMOOTH})) // ({{0}} + {SMOOTH} * {{1}}) END"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, text FROM documents),
words AS (SELECT lang, source, row, {_TERMS} AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_count FROM words GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCS}),
langs AS (SELECT d.lang, count(term) AS v, coalesce(sum(lang_count), 0)::BIGINT AS lang_n FROM (SELECT DISTINCT lang FROM docs) d LEFT JOIN kept k ON d.lang = k.lang GROUP BY d.lang),
counts AS (SELECT w.lang, source, term, count(*) AS c FROM words w SEMI JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
groups AS (SELECT g.lang, g.source, v, lang_n, coalesce((SELECT sum(c) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM docs) g JOIN langs USING (lang)),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {_SHARE.format("n", "v", "coalesce(c.c, 0)")} AS p, {_SHARE.format("lang_n", "v", "lang_count")} AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM dense WHERE c > 0 AND p > q),
placed AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= {TOP})
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM placed
"""


def brute(docs: list[tuple], least_docs: int = LEAST_DOCS, top: int = TOP) -> list[tuple]:
    """(lang, source, part, item, value, rank) over every term; for tests."""
    from collections import Counter, defaultdict

    split = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(*_LOWER)))
    df, per = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = split(text)
        df[lang or ""].update(set(words))
        per[lang or "", source or ""].update(words)
    kept = {lang: sorted(t for t, n in c.items() if n >= least_docs) for lang, c in df.items()}
    share = lambda c, terms: {t: 1 + SCALE * (c[t] + SMOOTH) // (sum(c[x] for x in terms) + SMOOTH * len(terms)) for t in terms}
    p = {g: share(c, kept[g[0]]) for g, c in per.items()}
    out = []
    for (lang, source), c in per.items():
        whole = Counter()
        for (other_lang, _), x in per.items():
            whole += x if other_lang == lang else Counter()
        q = share(whole, kept[lang])
        pairs = [(-sum(abs(p[lang, source][t] - p[lang, o][t]) for t in kept[lang]), o) for other_lang, o in per if other_lang == lang and o != source]
        terms = [(q[t] - p[lang, source][t], t) for t in kept[lang] if c[t] and p[lang, source][t] > q[t]]
        for part, rows in (("pair", sorted(pairs, key=lambda r: (r[0], r[1].encode()))), ("term", sorted(terms, key=lambda r: (r[0], r[1].encode()))[:top])):
            out += [(lang, source, part, item, -v, i + 1) for i, (v, item) in enumerate(rows)]
    return out
