"""Quality rules: exact document statistics, and boosted trees over them.

The statistics are exact integers.  The verdict comes from gradient-boosted trees over
rates derived from them, fitted on a bounded sample of labelled rows
(``train_rows``, the least hashed ids), flattened to node arrays and scored in numpy.
Monotonic limits: more symbols, duplicate lines, repeated words, capitals or pipes never
raise the score.

Edge cases: a null or empty text has zero statistics, fails the base rules and is not
kept; very long texts are measured whole; repeated rows each get their row, and of labelled
ids with several texts those of least hash are fitted on; an id labelled twice has its larger
label; with no labelled rows the model is constant and keeps every document that passes the
base rules; an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt, store
from . import text as tx

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "pipe_rate", "digit_rate", "word_length", "log_words", "distinct_rate", "line_words", "bang_rate")
MONOTONE = (-1, -1, -1, -1, -1, 0, 0, 0, 0, 0, -1)
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _has_equal(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items (doc, hash): equal to an earlier item of its document; equal to any other."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    d, k = doc[order], h[order]
    same = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    later, other = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:][same]] = True
    other[order[1:][same]] = True
    other[order[:-1][same]] = True
    return later, other


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Integer statistics (STATS) and rates (RATES) of each text."""
    b = tx.Block(texts)
    hasher = tx.Hasher(b.cp)
    token = tx.is_token(b.cp)
    s, e, doc = b.runs(token)
    n = np.bincount(doc, minlength=b.n)
    symbol = np.isin(b.cp, np.array([ord(c) for c in SYMBOLS], np.uint32))
    ls, le, ld = b.lines()
    full = np.searchsorted(s, ls, "left") < np.searchsorted(s, le, "left")
    ls, le, ld = ls[full], le[full], ld[full]
    later, _ = _has_equal(ld, hasher.spans(ls, le))
    dup = np.bincount(ld[later], minlength=b.n)
    h = hasher.spans(s, e)
    at = tx.firsts(doc, 3)
    _, other = _has_equal(doc[at], tx.ngrams(h, 3)[at])
    covered = np.zeros(len(s) + 3, np.int64)
    hit = at[other]
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + 3, -1)
    repeat = np.bincount(doc[np.cumsum(covered)[: len(s)] > 0], minlength=b.n)
    chars = b.sums(token)
    stats = np.stack([n, chars, b.sums(symbol), dup, repeat], 1)
    kind = tx.letter_table()[b.cp]
    again, _ = _has_equal(doc, h)
    lines = np.bincount(ld, minlength=b.n)
    c, w = np.maximum(chars, 1), np.maximum(n, 1)
    rates = np.stack([stats[:, 2] / c, dup / np.maximum(lines, 1), repeat / w, b.sums(kind == 3) / c, b.sums(b.cp == 124) / w, b.sums(kind == 4) / c, chars / w, np.log1p(n), 1 - np.bincount(doc[again], minlength=b.n) / w, n / np.maximum(lines, 1), b.sums(b.cp == 33) / w], 1)
    return stats, rates


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])


def _measured(batches):
    for batch in batches:
        for lo, hi in tx.slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            _, rates = measure(tx.texts_of(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(2), *(pa.array(r) for r in rates.T)], names=["label", *RATES])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 4000, trees: int = 60, depth: int = 3) -> gbt.Forest:
    """Fits on at most ``train_rows`` labelled documents."""
    rows = store.labelled(docs, labels, train_rows, id_col=id_col, text_col=text_col, label_col=label_col)
    fields = ", ".join(f"{c} double" for c in ("label", *RATES))
    got = rows.mapInArrow(_measured, fields).toPandas().to_numpy(float).reshape(-1, 1 + len(RATES))
    got = got[np.lexsort(got.T)]
    return gbt.fit(got[:, 1:], got[:, 0], trees=trees, depth=depth, monotone=MONOTONE)


def assess(docs: DataFrame, model: gbt.Forest, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, statistics, base_failed, kept, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi in tx.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                stats, rates = measure(tx.texts_of(part.column(1)))
                failed, score = base_failed(stats), shared.value.probability(rates)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in stats.T), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], names=[id_col, *STATS, "base_failed", "kept", "score"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, kept boolean, score double"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    return assess(docs, train(docs, store.table(spark, sf_dir, "labels")))
