"""Ranked lexical search by a threshold-seeded join.

Documents are read once: a pass in numpy writes, for every document, its length and the
occurrences of those terms that some item asks for (the postings).  A posting's impact does
not depend on the item, so each term keeps its number of documents, its greatest impact and
the postings of its k greatest impacts.  An item is then answered in four steps.

* Seeds: the stored postings of an item's terms, summed by document, bound the item's k-th
  score from below (one term's k-th impact is such a bound already; the sum is at least it).
* Pruning: terms are put in order of their greatest possible share of a score.  The tail of
  terms whose shares together stay below the bound cannot lift a document to it alone, so no
  candidate is looked for there.
* Candidates: the postings of the other terms, summed by document.  The k-th such sum is a
  new bound, and candidates that cannot reach it with the whole tail go.
* Rescoring: what is left is scored over all terms of the item, and the k best stay.

Every bound is an integer and safe, equal scores included, so results are those of scoring
every document.  Sides of joins are broadcast when they are counted to be few, beyond that
joins shuffle; no term's postings and no item's candidates are gathered in a task.

Terms are compared by 64-bit hashes: of T different terms in documents and Q in items, T * Q /
2^64 are expected to be taken for equal wrongly.

Edge cases: null and empty texts have no terms and are not counted; very long texts are read
whole; every row is a document of its own, and rows that share an id share nothing else; rows
of an item that share id and text are one item, with different texts they are ranked one by
one; items without terms, and items whose terms occur nowhere, have no rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from . import text as tx

K = 20
#: Rows of a side of a join, or terms sent to the tasks, that are broadcast at most.
FEW = 1_000_000
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _is_term(cp: np.ndarray) -> np.ndarray:
    return ((cp - np.uint32(48)) < 10) | ((cp - np.uint32(97)) < 26) | (cp >= 128)


def counts(texts: list[str], known: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(terms of each text, and document, term hash, occurrences of each different term of a
    document that is in ``known``: sorted hashes, or all)."""
    b = tx.Block(texts)
    low = tx.ascii_lower(b.cp)
    s, e, doc = b.runs(_is_term(low))
    h = tx.Hasher(low).spans(s, e).view(np.int64)
    n = np.bincount(doc, minlength=b.n)
    if known is not None:
        on = tx.member(known, h) >= 0
        doc, h = doc[on], h[on]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
    return n, doc[first], h[first], np.diff(np.append(first, len(h)))


def item_terms(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, id, term, times) of every different item: ``item`` numbers (id, text)."""
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct()
    rows = store.keep(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi in tx.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                _, doc, h, tf = counts(tx.texts_of(part.column(1)))
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column(2).take(at), part.column(0).take(at), pa.array(h), pa.array(tf)], names=["item", "id", "term", "times"])

    return store.keep(rows.mapInArrow(run, f"item long, id {kind}, term long, times long"), "item-terms")


def postings(docs: DataFrame, terms: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row, id, n, term, tf), kept in the shared folder: one with a null term for every
    document, and one for each of its ``terms``.  ``row`` numbers the rows of documents."""
    spark = docs.sparkSession
    wanted = terms.select("term").distinct()
    some = wanted.limit(FEW + 1).toArrow()["term"].to_numpy()
    known = spark.sparkContext.broadcast(np.sort(some) if len(some) <= FEW else None)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi in tx.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                n, doc, h, tf = counts(tx.texts_of(part.column(1)), known.value)
                at = np.concatenate((np.arange(len(n)), doc))
                blank = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(at)), part.column(0).take(pa.array(at)), pa.array(n[at]), pa.concat_arrays([blank, pa.array(h)]), pa.concat_arrays([blank, pa.array(tf)])], names=["row", "id", "n", "term", "tf"])

    found = rows.mapInArrow(run, f"row long, id {kind}, n long, term long, tf long")
    if len(some) > FEW:
        found = found.where("term is null").unionByName(found.where("term is not null").join(wanted, "term", "left_semi"))
    return store.keep(found, "postings")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(item, bound): the k-th greatest ``score`` of each item that has so many."""
    w = Window.partitionBy("item").orderBy(F.col("score").desc())
    return sums.select("item", "score", F.row_number().over(w).alias("at")).where(F.col("at") <= k).where(F.col("at") == k).select("item", F.col("score").alias("bound"))


def impacts(found: DataFrame) -> DataFrame:
    """(row, id, term, impact, docs: N) of postings."""
    total = found.where("term is null").agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    docs, terms = total["docs"], max(total["terms"], 1)
    m = f"(75 + (25L * n * {docs}L) div {terms}L)"
    impact = F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * {m})")
    return found.where("term is not null").select("row", "id", "term", impact.alias("impact"), F.lit(docs).cast("long").alias("docs"))


def rank(docs: DataFrame, items: DataFrame, k: int = K, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item id, rank, document id, score) of the k best documents of every item."""
    store.bound_batches(docs.sparkSession)
    asked = item_terms(items, id_col=item_col, text_col=item_text_col)
    hits = impacts(postings(docs, asked, id_col=id_col, text_col=text_col))
    # what each term keeps: documents, greatest impact, postings of the k greatest
    weight = F.floor(1000 * F.log((2 * F.first("docs") + 2) / (2 * F.count("*") + 1))).cast("long")
    terms = store.keep(hits.groupBy("term").agg(F.max("impact").alias("best"), weight.alias("weight")), "terms")
    first = Window.partitionBy("term").orderBy(F.col("impact").desc(), "row")
    tops = hits.select("row", "term", "impact", F.row_number().over(first).alias("at")).where(F.col("at") <= k)
    shares = store.keep(asked.join(_few(terms), "term").where("weight > 0").select("item", "term", (F.col("times") * F.col("weight")).alias("share"), (F.col("times") * F.col("weight") * F.col("best")).alias("most")), "shares")
    # seeds: sums of stored postings, each no more than the document's score
    seeds = tops.join(_few(shares.select("item", "term", "share")), "term").groupBy("item", "row").agg(F.sum(F.col("share") * F.col("impact")).alias("score"))
    seeded = store.keep(_kth(seeds, k), "seeded")
    # pruning: the least shares of an item, as far as their sum stays below its bound
    upward = Window.partitionBy("item").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    bounded = shares.join(_few(seeded), "item", "left").withColumn("bound", F.greatest(F.coalesce("bound", F.lit(0).cast("long")), F.lit(1).cast("long")))
    cut = store.keep(bounded.withColumn("upto", F.sum("most").over(upward)).withColumn("tail", F.col("upto") < F.col("bound")), "pruned")
    limits = cut.groupBy("item").agg(F.first("bound").alias("seed"), F.coalesce(F.max(F.when(F.col("tail"), F.col("upto"))), F.lit(0).cast("long")).alias("rest"))
    # candidates: documents with a term that is not pruned
    partial = hits.join(_few(cut.where("not tail").select("term", "item", "share")), "term").groupBy("item", "row", "id").agg(F.sum(F.col("share") * F.col("impact")).alias("score"))
    partial = store.keep(partial, "candidates")
    reach = limits.join(_kth(partial, k), "item", "left").select("item", (F.greatest(F.col("seed"), F.coalesce("bound", F.lit(0).cast("long"))) - F.col("rest")).alias("least"))
    left = store.keep(partial.join(_few(reach), "item").where("score >= least").drop("least"), "survivors")
    # rescoring: the pruned terms of the documents that are left
    tail = _few(cut.where("tail").select("item", "term", "share"))
    more = hits.select("row", "term", "impact").join(_few(left.select("item", "row", "id")), "row").join(tail, ["item", "term"]).select("item", "row", "id", (F.col("share") * F.col("impact")).alias("score"))
    scored = left.unionByName(more).groupBy("item", "row", "id").agg(F.sum("score").alias("score"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "id", "row")
    best = scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select("item", F.col("id").alias("item_id")).distinct()
    return best.join(_few(names), "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"))


_TERMS = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
ORACLE = f"""
WITH words AS (SELECT doc_id, {_TERMS} AS term FROM documents),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
posts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), size),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN posts USING (term) JOIN lengths USING (doc_id), size GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= {K}
"""


def brute(docs: list[tuple], items: list[tuple], k: int = K) -> list[tuple]:
    """(item id, rank, document id, score) by scoring every document; for tests."""
    import math
    from collections import Counter

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(*_LOWER)))
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(split(text))
        scores = []
        for i, c, size in held:
            m = 75 + 25 * size * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out
