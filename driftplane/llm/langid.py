"""Language identification by word-first backoff.

Training counts words and character n-grams (1 to ``MAX_N``, within words) by language in
a bounded sample of labelled rows: ``per_lang`` documents of least hashed id of every
language found, however many.  They are found in one pass over ids and labels (each task
keeps its best of each language before anything is shuffled); the counts are made in Spark,
and only the model comes to the driver.  If it had more than ``max_entries`` numbers (one
for each language and each word or n-gram known), the number of times that a word or n-gram
must be met doubles until it has not.

A known word scores by its smoothed log frequency in each language.  An unseen word scores
by its longest n-grams that any language knows: all n-grams of length MAX_N are tried, then
shorter ones, down to single characters.  A document's score is the mean over its words,
sharpened to a posterior.

Words are runs of letters and of marks beside them; digits and punctuation are cut off.

Edge cases: null texts and texts without a letter give ``und`` with score 0; very long
texts are scored whole; with no labelled rows everything is ``und``; a word with only unseen
characters is neutral; ties go to the language that sorts first; repeated rows each get
their row, and of rows that repeat an id the sample takes those of least hashed text; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from . import text as tx

MAX_N = 5
WORD_SMOOTHING, GRAM_SMOOTHING = 0.5, 0.5
SALTS = 8


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray
    word_logp: np.ndarray
    grams: list[np.ndarray]
    gram_logp: list[np.ndarray]


def _spans(b: tx.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points, and the maximal runs of letters."""
    low = tx.lower_table()[b.cp]
    kind = tx.letter_table()[low]
    s, e, doc = b.runs((kind & 11) > 0)
    letters = np.concatenate(([0], np.cumsum((kind & 3) > 0)))
    some = letters[e] > letters[s]
    return low, s[some], e[some], doc[some]


def _grams(hasher: tx.Hasher, s: np.ndarray, e: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside the spans, and the span that each comes from."""
    k = np.maximum(e - s - n + 1, 0)
    of = np.repeat(np.arange(len(s)), k)
    at = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k) + s[of]
    return hasher.spans(at, at + n), of


def counted(texts: list[str], lang: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(0 for words or the length of n-grams, hashes, languages, how often) in the texts."""
    low, s, e, d = _spans(tx.Block(texts))
    hasher = tx.Hasher(low)
    for n in range(MAX_N + 1):
        h, of = (hasher.spans(s, e), np.arange(len(s))) if n == 0 else _grams(hasher, s, e, n)
        pairs, times = np.unique(np.stack([h, lang[d[of]].astype(np.uint64)], 1), axis=0, return_counts=True)
        yield n, pairs[:, 0], pairs[:, 1].astype(np.int64), times


def _table(keys: np.ndarray, lang: np.ndarray, times: np.ndarray, total: np.ndarray, distinct: int, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their log frequencies by language, centred."""
    uniq, code = np.unique(keys, return_inverse=True)
    counts = np.zeros((len(uniq), len(total)), np.float32)
    counts[code, lang] = times
    logp = np.log((counts + smoothing) / (np.maximum(total, 1) + smoothing * max(distinct, 1)))
    logp -= logp.sum(1, keepdims=True) / max(logp.shape[1], 1)
    return uniq, logp.astype(np.float32)


def _model(names: list[str], n: np.ndarray, keys: np.ndarray, lang: np.ndarray, times: np.ndarray, totals: np.ndarray, distinct: np.ndarray) -> Model:
    made = [_table(keys[n == k], lang[n == k], times[n == k], totals[k], int(distinct[k]), GRAM_SMOOTHING if k else WORD_SMOOTHING) for k in range(MAX_N + 1)]
    return Model(names, made[0][0], made[0][1], [m[0] for m in made[1:]], [m[1] for m in made[1:]])


def fit(texts: list[str], langs: list[str], *, least: int = 2) -> Model:
    """The model of a few texts, in memory."""
    names = sorted(set(langs))
    code = np.array([names.index(x) for x in langs], np.int64)
    totals, distinct, parts = np.zeros((MAX_N + 1, len(names))), np.zeros(MAX_N + 1), []
    for n, h, lang, times in counted(texts, code) if texts else ():
        np.add.at(totals[n], lang, times)
        uniq, at = np.unique(h, return_inverse=True)
        distinct[n] = len(uniq)
        on = np.bincount(at, times, len(uniq))[at] >= least
        parts.append((np.full(on.sum(), n), h[on], lang[on], times[on]))
    return _model(names, *(np.concatenate(x) for x in zip(*parts, strict=True)), totals, distinct) if parts else _model(names, *(np.zeros(0, k) for k in (np.int64, np.uint64, np.int64, np.int64)), totals, distinct)


def score(model: Model, texts: list[str], sharp: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language (-1: und) and its posterior, by text."""
    b = tx.Block(texts)
    low, s, e, doc = _spans(b)
    n_words = np.bincount(doc, minlength=b.n)
    if not model.langs:
        return np.full(b.n, -1), np.zeros(b.n)
    hasher = tx.Hasher(low)
    # each distinct word of the block is scored once
    keys, first, code = np.unique(hasher.spans(s, e), return_index=True, return_inverse=True)
    ps, pe = s[first], e[first]
    points = np.zeros((len(keys), len(model.langs)), np.float32)
    at = tx.member(model.words, keys)
    points[at >= 0] = model.word_logp[at[at >= 0]]
    left = np.flatnonzero(at < 0)
    for n in range(MAX_N, 0, -1):
        if not len(left):
            break
        h, of = _grams(hasher, ps[left], pe[left], n)
        hit = tx.member(model.grams[n - 1], h)
        of, hit = of[hit >= 0], hit[hit >= 0]
        k = np.bincount(of, minlength=len(left))
        for j in range(len(model.langs)):
            points[left, j] += np.bincount(of, model.gram_logp[n - 1][hit, j], len(left)) / np.maximum(k, 1)
        left = left[k == 0]
    total = np.stack([np.bincount(doc, points[code, j], b.n) for j in range(len(model.langs))], 1)
    mean = total / np.maximum(n_words, 1)[:, None]
    p = np.exp(sharp * (mean - mean.max(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return np.where(n_words > 0, best, -1), np.where(n_words > 0, p[np.arange(b.n), best], 0.0)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, least: int = 2, max_entries: int = 50_000_000) -> Model:
    """Fits on the rows given, ``per_lang`` documents a language at most."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("g")).where("g is not null and t is not null")
    rows = rows.withColumn("h", F.xxhash64("t"))
    some = rows.select("g", "i", "h", F.pmod("h", F.lit(SALTS)).alias("s"))
    for part in (["g", "s"], ["g"]):  # the best of each part of a language, then of all
        best = Window.partitionBy(*part).orderBy(F.xxhash64("i"), "i", "h")
        some = some.withColumn("k", F.row_number().over(best)).where(F.col("k") <= per_lang).drop("k")
    some = some.drop("s").distinct()
    some = store.keep(some, "sample")
    names = sorted(r[0] for r in some.select("g").distinct().collect())
    if not names:
        return fit([], [])
    code = {x: k for k, x in enumerate(names)}
    few = some.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("h").alias("_h"))
    same = (rows["g"] == few["_g"]) & rows["i"].eqNullSafe(few["_i"]) & (rows["h"] == few["_h"])
    texts = rows.join(F.broadcast(few) if per_lang * len(names) <= 2_000_000 else few, same, "left_semi").select("g", "h", "t").repartition(spark.sparkContext.defaultParallelism, "g", "h").dropDuplicates(["g", "h"])

    def run(batches):
        for batch in batches:
            for lo, hi in tx.slices(batch.column(1), tx.BLOCK_CHARS // 2):
                part = batch.slice(lo, hi - lo)
                lang = np.array([code[x] for x in part.column(0).to_pylist()], np.int64)
                for n, h, g, times in counted(tx.texts_of(part.column(1)), lang):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n), pa.int32()), pa.array(h.view(np.int64)), pa.array(g), pa.array(times)], names=["n", "key", "lang", "times"])

    made = texts.select("g", "t").mapInArrow(run, "n int, key long, lang long, times long").groupBy("n", "key", "lang").agg(F.sum("times").alias("times"))
    counts = store.keep(made.groupBy("n", "key").agg(F.sum("times").alias("all"), F.collect_list(F.struct("lang", "times")).alias("by")), "counts")
    totals, distinct = np.zeros((MAX_N + 1, len(names))), np.zeros(MAX_N + 1)
    for n, lang, times in counts.select("n", F.explode("by").alias("b")).groupBy("n", "b.lang").agg(F.sum("b.times")).collect():
        totals[n, lang] = times
    for n, k in counts.groupBy("n").count().collect():
        distinct[n] = k
    # a key is a row of the model, with a number for every language
    while (counts.where(F.col("all") >= least).count()) * len(names) > max_entries:
        least *= 2
    got = counts.where(F.col("all") >= least).select("n", "key", F.explode("by").alias("b")).select("n", "key", "b.lang", "b.times").toArrow()
    store.drop(counts)
    store.drop(some)
    n, key, lang, times = (np.asarray(got[c]) for c in ("n", "key", "lang", "times"))
    return _model(names, n, key.view(np.uint64), lang, times, totals, distinct)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches):
        names = np.array([*shared.value.langs, "und"], object)
        for batch in batches:
            for lo, hi in tx.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                best, p = score(shared.value, tx.texts_of(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(p)], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    out = identify(docs, train(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in an identified language; texts without a letter go, and texts
    whose best language is hardly likelier than chance."""
    store.bound_batches(spark)
    model = train(docs.where(~held_out()))
    shared, schema = spark.sparkContext.broadcast(model), docs.schema
    at = schema.names.index("text")

    def run(batches):
        for batch in batches:
            for lo, hi in tx.slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                best, p = score(shared.value, tx.texts_of(part.column(at)))
                yield part.filter(pa.array((best >= 0) & (p >= 1.2 / max(2, len(shared.value.langs)))))

    return docs.mapInArrow(run, schema)
