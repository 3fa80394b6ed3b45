"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive item words (an item of fewer words is one window).
Of every run of w consecutive k-grams the least hashed ones are kept as fingerprints, with
w + k - 1 equal to the window, so any shared window shares a fingerprint.  Documents are
fingerprinted the same way.  Fingerprints of both sides are joined; a match is extended to
every window around it, and windows that occur in an item mark their words as hit.

Documents are read once, and their texts never shuffled: a pass writes, for each document,
its number of words, and for each fingerprint that may be in the benchmark the windows
around it.  "May be" is a bitmap of the benchmark's fingerprints, of ``MAX_BITS`` bits at
most, whatever the benchmark's size; what it lets through wrongly the join drops.  The
benchmark is only ever a table: its sides of joins are broadcast when counted to be few,
beyond that the joins shuffle.

Words, fingerprints and windows are compared by 64-bit hashes: of D document windows and B
benchmark windows, D * B / 2^64 are expected to be taken for equal wrongly.

Edge cases: null and empty texts have no words; very long texts are searched whole; items
without words match nothing; several rows of one item id count as one item; items with a
null id mark words but are not listed; repeated documents each get their row, and rows that
share an id but not a text are kept apart by a hash of the text; an empty benchmark hits
nothing, an empty table gives an empty result; other columns, whatever their names, are
ignored (and kept by the stage).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from . import text as tx

WINDOW, GRAM = 10, 5
LEAST_BITS, MAX_BITS = 1 << 22, 1 << 28
#: Rows of the benchmark's side of a join that are broadcast at most.
FEW = 1_000_000


def _is_word(cp: np.ndarray) -> np.ndarray:
    return ((cp - np.uint32(48)) < 10) | ((cp - np.uint32(97)) < 26) | (cp >= 128)


def _words(texts: list[str]) -> tuple[tx.Block, np.ndarray, np.ndarray]:
    """The block, and the document and hash of each of its words."""
    b = tx.Block(texts)
    low = tx.ascii_lower(b.cp)
    s, e, doc = b.runs(_is_word(low))
    return b, doc, tx.Hasher(low).spans(s, e)


def _gram(window: int) -> int:
    return min(GRAM, window)


def winnow(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are least in some run of w of them."""
    k = _gram(window)
    g, w = tx.ngrams(h, k), window - k + 1
    m = len(g) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = g[:m].copy()
    for j in range(1, w):
        np.minimum(least, g[j : m + j], out=least)
    kept = np.zeros(len(g), bool)
    for j in range(w):
        kept[j : m + j] |= g[j : m + j] == least
    at = np.flatnonzero(kept)
    return at, g[at]


def _windows(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(window):
        out *= np.uint64(0xD1342543DE82EF95)
        out += h[at + j]
    return tx.mix(out)


def _tagged(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes that differ by window length, as signed integers."""
    return tx.mix(h + np.uint64(length) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _of_items(texts: list[str], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(kind, length, item, hash) of every fingerprint (kind 0) and window (kind 1)."""
    _, doc, h = _words(texts)
    counts = np.bincount(doc, minlength=len(texts))
    out = [np.zeros((0, 4), np.int64)]
    for length in sorted({min(int(c), window) for c in counts if c}):
        own = ((counts >= window) if length == window else (counts == length))[doc]
        d, x = doc[own], h[own]
        at = tx.firsts(d, length)
        where, prints = winnow(x, length)
        inside = d[where] == d[np.minimum(where + _gram(length) - 1, len(d) - 1)]
        for kind, item, hashes in ((0, d[where[inside]], prints[inside]), (1, d[at], _windows(x, at, length))):
            out.append(np.stack([np.full(len(item), kind), np.full(len(item), length), item, _tagged(hashes, length)], 1))
    return tuple(np.concatenate(out).T)


def of_benchmark(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(kind, length, hash, item) of the benchmark, kept in the shared folder."""

    def run(batches):
        for batch in batches:
            for lo, hi in tx.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                kind, length, item, h = _of_items(tx.texts_of(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(length, pa.int32()), pa.array(h, pa.int64()), part.column(0).take(pa.array(item, pa.int64()))], names=["kind", "length", "hash", "item"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    return store.keep(rows.mapInArrow(run, "kind int, length int, hash long, item string").distinct(), "benchmark")


def bitmap(prints: DataFrame) -> np.ndarray:
    """A set of bits that holds two for each hash, 16 bits a hash until there are MAX_BITS."""
    bits = LEAST_BITS
    n = prints.count()
    while bits < min(16 * n, MAX_BITS):
        bits *= 2
    at = F.explode(F.array(F.col("hash").bitwiseAND(bits - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(bits - 1)))
    rows = prints.select(at.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    got = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[np.asarray(got["w"])] = np.asarray(got["b"])
    return out.view(np.uint64)


def _may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    u, mask = h.view(np.uint64), np.uint64(len(bits) * 64 - 1)
    on = np.ones(len(u), bool)
    for p in (u & mask, (u >> np.uint64(32)) & mask):
        on &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return on


def _marks(doc: np.ndarray, h: np.ndarray, lengths: list[int], bits: np.ndarray) -> list[np.ndarray]:
    """(document, fingerprint, start, length, window) of the windows about fingerprints that
    the benchmark may have."""
    out = [np.zeros((0, 5), np.int64)]
    for length in lengths:
        k = _gram(length)
        at, prints = winnow(h, length)
        tagged = _tagged(prints, length)
        on = _may_hold(bits, tagged)
        starts = at[on][:, None] - np.arange(length - k + 1)
        of = np.repeat(tagged[on], length - k + 1)
        starts = starts.ravel()
        ok = (starts >= 0) & (starts + length <= len(h))
        ok[ok] = doc[starts[ok]] == doc[starts[ok] + length - 1]
        starts, of = starts[ok], of[ok]
        out.append(np.stack([doc[starts], of, starts, np.full(len(starts), length), _tagged(_windows(h, starts, length), length)], 1))
    return list(np.concatenate(out).T)


def _joined(rows: DataFrame, few: DataFrame, key: str, how: str) -> DataFrame:
    """Joins with the benchmark's side, broadcast if counted to be few."""
    return rows.join(F.broadcast(few) if few.limit(FEW + 1).count() <= FEW else few, key, how)


def search(docs: DataFrame, benchmark: DataFrame, *, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, n_words) of every document, and (id, text_hash, n_hit, items) of those
    with a hit."""
    spark = docs.sparkSession
    bench = of_benchmark(benchmark, id_col=item_col, text_col=item_text_col)
    prints = bench.where("kind = 0").select("hash").distinct()
    lengths = sorted(r[0] for r in bench.select("length").distinct().collect())  # WINDOW rows at most
    shared = spark.sparkContext.broadcast((lengths, bitmap(prints)))
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi in tx.slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                b, doc, h = _words(tx.texts_of(part.column(2)))
                first = np.searchsorted(doc, np.arange(b.n))
                d, of, start, length, window = _marks(doc, h, *shared.value)
                of_doc = lambda x, at, t=pa.int64(): pa.concat_arrays([pa.nulls(b.n, t), pa.array(x, t)])
                rows = pa.array(np.concatenate((np.arange(b.n), d)))
                n = pa.concat_arrays([pa.array(np.bincount(doc, minlength=b.n)), pa.nulls(len(d), pa.int64())])
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), n, of_doc(of, d), of_doc(start - first[d], d), of_doc(length, d, pa.int32()), of_doc(window, d)], names=["id", "text_hash", "n_words", "print", "start", "length", "window"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    read = store.keep(rows.mapInArrow(run, f"id {kind}, text_hash long, n_words long, print long, start long, length int, window long"), "fingerprints")
    same = _joined(read.where("print is not null"), prints.withColumnRenamed("hash", "print"), "print", "left_semi")
    windows = bench.where("kind = 1").select(F.col("hash").alias("window"), "item").distinct()
    hits = _joined(same.select("id", "text_hash", "start", "length", "window").distinct(), windows.select("window").distinct(), "window", "left_semi")
    hits = store.keep(hits, "hits")
    # the union of the spans, in order of their starts
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    more = lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).cast("long").alias("n"))
    n_hit = hits.groupBy("id", "text_hash").agg(F.aggregate(F.array_sort(F.collect_list(span)), zero, more)["n"].alias("n_hit"))
    named = _joined(hits.select("id", "text_hash", "window").distinct(), windows.where("item is not null"), "window", "inner")
    items = named.select("id", "text_hash", "item").distinct().groupBy("id", "text_hash").agg(F.array_sort(F.collect_list("item")).alias("items"))
    i = items.select(F.col("id").alias("_i"), F.col("text_hash").alias("_h"), "items")
    found = n_hit.join(i, n_hit["id"].eqNullSafe(i["_i"]) & (n_hit["text_hash"] == i["_h"]), "left").drop("_i", "_h")
    return read.where("print is null").select("id", "text_hash", "n_words"), found


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items: the sorted ids as strings) of every document."""
    read, found = search(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col)
    f = found.select(F.col("id").alias("_i"), F.col("text_hash").alias("_h"), "n_hit", "items")
    out = read.join(f, read["id"].eqNullSafe(f["_i"]) & (read["text_hash"] == f["_h"]), "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark window."""
    store.bound_batches(spark)
    _, found = search(docs, store.table(spark, sf_dir, "benchmark"), id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text")
    gone = store.keep(found.select(F.col("id").alias("_i"), F.col("text_hash").alias("_h")), "contaminated")
    on = docs["doc_id"].eqNullSafe(gone["_i"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_h"])
    return docs.join(F.broadcast(gone) if gone.count() <= FEW else gone, on, "left_anti")


def brute(texts: list[str | None], items: list[tuple[str, str]]) -> list[tuple[int, int, list[str]]]:
    """(words, hit words, items) by direct comparison of every window; for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    made = [(name, [w[i : i + WINDOW] for i in range(max(1, len(w) - WINDOW + 1))]) for name, t in items if (w := split(t))]
    out = []
    for t in texts:
        words, hit, names = split(t), set(), set()
        for name, windows in made:
            for x in windows:
                for i in range(len(words) - len(x) + 1):
                    if words[i : i + len(x)] == x:
                        hit |= set(range(i, i + len(x)))
                        names.add(name)
        out.append((len(words), len(hit), sorted(names)))
    return out
