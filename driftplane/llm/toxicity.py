"""Toxicity: boosted trees over dense features of the whole text, calibrated.

1. A lexicon of word hashes is learned from labelled rows: words whose document frequency
   is far higher among toxic texts, in both of two halves of the sample (so that one
   family of copies cannot promote its own words), beside a short seed list.
2. Features: plain and obfuscated lexicon densities, the densest stretch of 20 words,
   lexicon words near second-person words, capitals, punctuation and obfuscation rates.
3. Gradient-boosted trees on those features, monotone in the lexicon features.
4. Isotonic calibration on labelled rows that neither lexicon nor trees have seen.

The fit uses at most ``train_rows`` labelled rows (the least hashed ids); lexicon counts
are aggregated by Spark, so the driver sees only words that pass and feature rows.

Edge cases: null and empty texts have zero features and a score like any other; very long
texts are measured whole; repeated rows each get their row; equal texts count once in the
lexicon, as toxic if any of them is labelled so; words of equal odds are taken by hash; with
no labelled rows the score is the constant prior 0.5; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt, store
from . import text as tx

#: Insults that seed the lexicon, and second-person words of some languages.
SEEDS = "idiot moron stupid loser trash scum clown pathetic worthless disgusting imbecile dumb filthy vermin hate".split()
SECOND = "you your yours yourself u ur du dich dir dein deine tu te toi ton vous votre usted ustedes vosotros ti tus".split()
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
FEATURES = ("plain_rate", "plain_log", "hidden_rate", "hidden_log", "densest", "near_second", "second_rate", "upper_rate", "shout_rate", "punct_rate", "bang_rate", "mixed_rate", "log_words")
MONOTONE = (1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
STRETCH, NEAR = 20, 5


@dataclass
class Model:
    lexicon: np.ndarray
    second: np.ndarray
    forest: gbt.Forest
    knots: tuple[np.ndarray, np.ndarray]


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(np.array([tx.hash_text(w) for w in words], np.uint64))


def _within(mark: np.ndarray, doc: np.ndarray, reach: int) -> np.ndarray:
    """How many marked words are at most ``reach`` before or after, in the same document."""
    n = len(mark)
    c = np.concatenate(([0], np.cumsum(mark)))
    first = np.searchsorted(doc, doc, "left")
    last = np.searchsorted(doc, doc, "right")
    at = np.arange(n)
    return c[np.minimum(at + reach + 1, last)] - c[np.maximum(at - reach, first)]


def _words(b: tx.Block):
    """Token spans, and hashes of each token's letters: as written, and with common
    substitutes read as letters and everything else cut out."""
    s, e, doc = b.words()
    low = tx.lower_table()[b.cp]
    letter = (tx.letter_table()[low] & 3) > 0
    follows = np.concatenate((letter[1:], [False])) & ~letter
    read = low.copy()
    for k, v in LEET.items():
        read[(low == ord(k)) & (follows | k.isdigit())] = ord(v)
    readable = letter | (read != low)

    def letters_of(cp: np.ndarray, keep: np.ndarray) -> np.ndarray:
        at = np.concatenate(([0], np.cumsum(keep)))
        return tx.Hasher(cp[keep]).spans(at[s], at[e])

    plain = letters_of(low, letter)
    inner = np.concatenate(([0], np.cumsum(~letter)))
    # a token is as written if its letters are one run; punctuation around it is no disguise
    lead, first_letter = np.flatnonzero(letter), np.zeros(len(s), np.int64)
    if len(lead):
        i = np.searchsorted(lead, s, "left")
        j = np.searchsorted(lead, e, "left") - 1
        has = j >= i
        fl, ll = lead[np.minimum(i, len(lead) - 1)], lead[np.maximum(j, 0)]
        gaps = np.where(has, inner[np.where(has, ll, 0)] - inner[np.where(has, fl, 0)], 0)
        first_letter = has.astype(np.int64)
    else:
        gaps = np.zeros(len(s), np.int64)
    hidden = letters_of(read, readable)
    return s, e, doc, plain, hidden, gaps > 0, first_letter > 0


def measure(texts: list[str], lexicon: np.ndarray, second: np.ndarray) -> np.ndarray:
    b = tx.Block(texts)
    s, e, doc, plain, hidden, mixed, wordy = _words(b)
    n = np.maximum(np.bincount(doc, minlength=b.n), 1)
    as_is = (tx.member(lexicon, plain) >= 0) & ~mixed
    disguised = ((tx.member(lexicon, plain) >= 0) | (tx.member(lexicon, hidden) >= 0)) & ~as_is
    bad, you = as_is | disguised, tx.member(second, plain) >= 0
    per = lambda m: np.bincount(doc[m], minlength=b.n)
    kind = tx.letter_table()[b.cp]
    upper = np.concatenate(([0], np.cumsum(kind == 3)))
    letters = np.concatenate(([0], np.cumsum((kind & 3) > 0)))
    n_upper, n_letters = upper[e] - upper[s], letters[e] - letters[s]
    dense = np.zeros(b.n)
    near = np.zeros(b.n)
    if bad.any():
        around = _within(bad, doc, STRETCH // 2)
        np.maximum.at(dense, doc[bad], around[bad])
        near += per(bad & (_within(you, doc, NEAR) > 0))
    c = np.maximum(b.chars, 1)
    punct = ~tx.is_token(b.cp) | ((kind & 7) > 0)
    k1, k2 = per(as_is), per(disguised)
    return np.stack([k1 / n, np.log1p(k1), k2 / n, np.log1p(k2), dense, np.log1p(near), per(you) / n, b.sums(kind == 3) / c, per((n_letters > 1) & (n_upper == n_letters)) / n, b.sums(~punct) / c, b.sums(b.cp == 33) / c, per(mixed & wordy) / n, np.log1p(np.bincount(doc, minlength=b.n))], 1).astype(float)


def _word_rows(batches):
    """Distinct word hashes of each labelled text."""
    for batch in batches:
        for lo, hi in tx.slices(batch.column(0)):
            part = batch.slice(lo, hi - lo)
            _, _, doc, plain, _, mixed, wordy = _words(b := tx.Block(tx.texts_of(part.column(0))))
            del b
            keep = wordy & ~mixed
            pair = np.unique(np.stack([doc[keep].astype(np.uint64), plain[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.uint64)
            d = pair[:, 0].astype(np.int64)
            label, half = np.asarray(part.column(1)), np.asarray(part.column(2))
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 1].view(np.int64)), pa.array(label[d]), pa.array(half[d])], names=["word", "label", "half"])


def _lexicon(fit_rows: DataFrame, size: int, ratio: float, least: int) -> np.ndarray:
    """Word hashes far likelier in toxic texts, in both halves of the sample."""
    rows = fit_rows.select("text", "label", "half")
    total = {(r[0], r[1]): r[2] for r in rows.groupBy("label", "half").count().collect()}
    cell = lambda t, h: F.sum(F.when((F.col("label") == t) & (F.col("half") == h), 1).otherwise(0))
    counts = rows.mapInArrow(_word_rows, "word long, label double, half int").groupBy("word").agg(*(cell(t, h).alias(f"c{t}{h}") for t in (0, 1) for h in (0, 1)))
    rate = lambda t, h: (F.col(f"c{t}{h}") + 0.5) / F.lit(total.get((float(t), h), 0) + 1.0)
    worst = F.least(rate(1, 0) / rate(0, 0), rate(1, 1) / rate(0, 1))
    found = counts.where((F.col("c10") >= least) & (F.col("c11") >= least)).where(worst >= ratio).orderBy(worst.desc(), "word").limit(size)
    return np.unique(np.concatenate([_hashes(SEEDS), np.array([r[0] for r in found.select("word").collect()], np.int64).view(np.uint64)]))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 8000, lexicon_size: int = 500, ratio: float = 12.0, least: int = 4, trees: int = 50, depth: int = 3) -> Model:
    """Fits on the labelled rows given, ``train_rows`` at most."""
    h = F.xxhash64(F.lit(7), F.col("id"))
    rows = store.labelled(docs, labels, train_rows, id_col=id_col, text_col=text_col, label_col=label_col)
    rows = rows.withColumns({"part": F.pmod(h, F.lit(10)).cast("int"), "half": F.pmod(F.floor(F.pmod(h, F.lit(1000)) / 10), F.lit(2)).cast("int")})
    rows = store.keep(rows.select("text", "label", "part", "half"), "labelled")
    # equal texts count once, as toxic if any of them is
    lexicon = _lexicon(rows.where("part < 7").groupBy("text").agg(F.max("label").alias("label"), F.min("half").alias("half")), lexicon_size, ratio, least)
    second = _hashes(SECOND)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, second))

    def run(batches):
        for batch in batches:
            for lo, hi in tx.slices(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                x = measure(tx.texts_of(part.column(0)), *shared.value)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *(pa.array(c) for c in x.T)], names=["label", "part", *FEATURES])

    got = rows.select("text", "label", "part").mapInArrow(run, "label double, part int, " + ", ".join(f"{c} double" for c in FEATURES)).toPandas().to_numpy(float).reshape(-1, 2 + len(FEATURES))
    store.drop(rows)
    got = got[np.lexsort(got.T)]
    y, part, x = got[:, 0], got[:, 1], got[:, 2:]
    forest = gbt.fit(x[part < 7], y[part < 7], trees=trees, depth=depth, monotone=MONOTONE, min_leaf=10)
    held = part >= 7 if (part >= 7).sum() >= 50 else np.full(len(y), True)
    knots = gbt.isotonic(forest.margin(x[held]), y[held]) if len(y) else (np.array([0.0]), np.array([0.5]))
    return Model(lexicon, second, forest, knots)


def scores(model: Model, texts: list[str]) -> np.ndarray:
    return np.interp(model.forest.margin(measure(texts, model.lexicon, model.second)), *model.knots)


def rate(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi in tx.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                p = np.clip(scores(shared.value, tx.texts_of(part.column(1))), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    model = train(docs, store.table(spark, sf_dir, "labels").where(~held_out()))
    return rate(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
