"""Mixing sources to target weights by entropy balancing.

Targets: sources take weights in turn, share ``budget`` times all words by weight, and stop
at ``most`` times their own words; the excess is reshared among the others.

Rates: of all rates r between 0 and ``most`` whose words add up to the source's target,
those closest in entropy to the present corpus (rate 1) are r = min(most, exp(v * size)).
The multipliers v maximise a concave dual with one token constraint a source; Newton steps,
kept inside a shrinking bracket, solve all sources at once, each step one distributed
aggregation over the table of (source, size, documents).

Copies: a document gets the whole part of its rate, and one more copy if it stands before
the cut of its source and size class in a hashed order that favours large fractions.  Cuts
are set from the largest class down, each class making up for the rounding of those before
it, from counts by (source, class, bucket): the rounding error is about one small bucket.
Rows alike in id, source and text are numbered, so that they spread over the buckets too.

Only (source, size) totals and one row a source are held at the driver: ``max_sources``
bounds them, and more is an error, as is a dual that does not converge.  Documents are never
grouped in one task.

Edge cases: null and empty texts have size 0 and take 0; very long texts count whole; a null
source is a source and sorts last; repeated rows are rounded one by one, alike ones being
interchangeable; a source without words has target 0; an empty table gives an empty result;
other columns stay, whatever their names (the stage's ``copy`` becomes ``copy_2`` and so on
where that is taken).  Reruns agree: the hashed order depends on the rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

WEIGHTS, BUDGET, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BUCKETS = 256


def targets(sizes: list[float], weights: list[float], budget: float, most: float = MOST) -> list[float]:
    """Shares of the budget by weight, none above ``most`` times its size."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), budget
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
            open_.discard(i)
        left -= sum(out[i] for i in full)
    return out


def words_in(c: Column) -> Column:
    """How many words ``[^\\x20\\x09-\\x0D]+`` a text has."""
    return F.coalesce(F.regexp_count(c, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def solve(hist: DataFrame, wanted: dict, start: dict, most: float, steps: int = 80, within: float = 1e-7) -> dict:
    """The multiplier of each source: Newton on the dual, kept inside a bracket.

    ``hist`` has (source, size, docs); ``wanted`` holds the target words of each source and
    ``start`` a first guess.  Every step is one aggregation of a row a source."""
    spark = hist.sparkSession
    lam, low, high = dict(start), dict.fromkeys(wanted, -np.inf), dict.fromkeys(wanted, np.inf)
    live = {s for s, t in wanted.items() if t > 0}
    for _ in range(steps):
        if not live:
            break
        rows = spark.createDataFrame([(s, lam[s]) for s in sorted(live, key=lambda x: (x is None, x or ""))], "s string, v double")
        r = F.exp(F.least(F.col("v") * F.col("size"), F.lit(50.0)))
        got = hist.join(F.broadcast(rows), hist["source"].eqNullSafe(rows["s"])).groupBy("s").agg(F.sum(F.col("docs") * F.col("size") * F.least(r, F.lit(most))).alias("g"), F.sum(F.when(r < most, F.col("docs") * F.col("size") * F.col("size") * r).otherwise(0.0)).alias("h"))
        for s, g, h in got.collect():
            miss = wanted[s] - g
            if abs(miss) <= within * wanted[s]:
                live.discard(s)
                continue
            if miss > 0:
                low[s] = lam[s]
            else:
                high[s] = lam[s]
            step = lam[s] + miss / h if h > 0 else np.inf
            if not low[s] < step < high[s]:
                lo = low[s] if np.isfinite(low[s]) else (2 * high[s] if high[s] < 0 else -abs(start[s]) - 1e-6)
                hi = high[s] if np.isfinite(high[s]) else (2 * low[s] if low[s] > 0 else abs(start[s]) + 1e-6)
                step = (lo + hi) / 2
            lam[s] = step
    if live:
        raise ArithmeticError(f"no multipliers found in {steps} steps for {len(live)} sources, such as {min(live, key=str)!r}")
    return {s: float(f"{v:.10g}") for s, v in lam.items()}


def cuts(counts: list[tuple[int, int, float, float]]) -> list[tuple[int, int]]:
    """For the (class, bucket, words, expected words) of one source: how many buckets of each
    class get one more copy.  From the largest class down, each class makes up for what
    those before it were off by."""
    by: dict[int, np.ndarray] = {}
    for size_class, bucket, words, expected in counts:
        by.setdefault(size_class, np.zeros((2, BUCKETS)))[:, bucket] += (words, expected)
    out, off = [], 0.0
    for size_class in sorted(by, reverse=True):
        words, expected = by[size_class]
        aim, sums = expected.sum() + off, np.concatenate(([0.0], np.cumsum(words)))
        cut = int(np.argmin(np.abs(sums - aim)))
        out.append((size_class, cut))
        off = aim - sums[cut]
    return out


#: Rows of a table that are broadcast at most.
FEW = 1_000_000
KEYS = ("id", "source", "text_hash")


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: bool = False) -> DataFrame:
    """(id, source, text_hash, size, nth) of each document, with all its columns as the
    struct ``row`` if asked.  ``nth`` numbers the rows that are alike, from 0."""
    whole = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if row else []
    rows = docs.select(*whole, docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("text_hash"), words_in(docs[text_col]).alias("size"))
    return _numbered(rows)


def _alike(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"_{k}"])
    return on


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows that share KEYS are found by counts; only they are written, with the task that
    wrote them, and numbered: no key's rows meet in one task."""
    again = store.keep(rows.groupBy(*KEYS).count().where("count > 1").select(*(F.col(k).alias(f"_{k}") for k in KEYS)), "alike")
    n = again.limit(FEW + 1).count()
    if n == 0:
        return rows.withColumn("nth", F.lit(0).cast("long"))
    side = F.broadcast(again) if n <= FEW else again
    some = store.keep(rows.join(side, _alike(rows, again, KEYS), "left_semi").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "repeated")
    before = Window.partitionBy(*KEYS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    keys = (*KEYS, "part")
    offsets = some.groupBy(*keys).count().withColumn("_first", F.coalesce(F.sum("count").over(before), F.lit(0))).select(*(F.col(k).alias(f"_{k}") for k in keys), "_first")
    within = some.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1)
    numbered = within.join(offsets, _alike(within, offsets, keys)).withColumn("nth", F.col("nth") + F.col("_first"))
    single = rows.join(side, _alike(rows, again, KEYS), "left_anti").withColumn("nth", F.lit(0).cast("long"))
    return single.unionByName(numbered.select(*single.columns))


@dataclass
class Plan:
    """What the fit leaves: a row a source (v, target), a row a source and size class (cut)."""

    sources: DataFrame
    limits: DataFrame
    most: float
    few_limits: bool = True

    def _placed(self, rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(self.sources), rows["source"].eqNullSafe(self.sources["_s"])).drop("_s")
        rate = F.least(F.lit(self.most), F.exp(F.least(F.col("_v") * F.col("size"), F.lit(50.0))))
        rows = rows.withColumn("rate", rate).withColumns({"_whole": F.floor("rate"), "_part": F.col("rate") - F.floor("rate"), "_class": F.floor(F.log2(F.greatest(F.col("size"), F.lit(1))) * 2).cast("int")})
        # one more copy goes by hash: logit of place = logit of hash - logit of the fraction
        u = (F.pmod(F.xxhash64("id", "source", "size", "text_hash", "nth"), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
        near, far = u * (1 - F.col("_part")), (1 - u) * F.col("_part")
        return rows.withColumn("_bucket", F.least(F.floor(near / (near + far) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` (as :func:`measured` makes them) with source_size, target, rate and
        copies.  A row a source is broadcast (``max_sources`` at most), a row a source and
        size class if counted to be few."""
        rows = self._placed(rows)
        side = F.broadcast(self.limits) if self.few_limits else self.limits
        rows = rows.join(side, rows["source"].eqNullSafe(self.limits["_s"]) & (rows["_class"] == self.limits["_c"]), "left")
        more = F.when((F.col("_part") > 0) & (F.col("size") > 0) & (F.col("_bucket") < F.col("_cut")), 1).otherwise(0)
        out = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("_whole") + more).otherwise(F.lit(1)).cast("long"))
        return out.drop("_s", "_c", "_cut", "_v", "_whole", "_part", "_class", "_bucket")


def fit(rows: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, max_sources: int = 100_000) -> Plan:
    """``rows`` as :func:`measured` makes them; they are read twice."""
    if most != int(most):
        raise ValueError("most must be a whole number: copies are")
    spark = rows.sparkSession
    hist = store.keep(rows.groupBy("source", "size").agg(F.count("*").alias("docs")), "histogram")
    n = F.col("docs") * F.col("size")
    found = hist.groupBy("source").agg(F.sum(n).alias("words"), F.sum(n * F.col("size")).alias("squares")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources")
    found = sorted(found, key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    names, words = [r["source"] for r in found], [float(r["words"]) for r in found]
    goal = targets(words, [weights[i % len(weights)] for i in range(len(names))], budget * sum(words), most)
    wanted = {n: g for n, g, w in zip(names, goal, words, strict=True) if g < most * w * (1 - 1e-12)}
    start = {r["source"]: float(np.log(wanted[r["source"]] / r["words"]) * r["words"] / r["squares"]) for r in found if wanted.get(r["source"], 0) > 0}
    tilt = solve(hist, {s: wanted[s] for s in start}, start, most)
    store.drop(hist)
    sources = spark.createDataFrame([(n, int(w), float(g), tilt.get(n, 1e9)) for n, w, g in zip(names, words, goal, strict=True)], "_s string, source_size long, target double, _v double")
    plan = Plan(sources, spark.createDataFrame([], "_s string, _c int, _cut int"), most)
    placed = plan._placed(rows).where("size > 0 and _part > 0")
    counts = placed.groupBy("source", "_class", "_bucket").agg(F.sum("size").cast("double").alias("words"), F.sum(F.col("size") * F.col("_part")).alias("expected"))

    def cut(frame):
        import pandas as pd

        made = cuts(list(zip(frame["_class"], frame["_bucket"], frame["words"], frame["expected"], strict=True)))
        return pd.DataFrame([(frame["source"].iloc[0], c, k) for c, k in made], columns=["_s", "_c", "_cut"])

    # at most (size classes x BUCKETS) rows a source, however many documents
    plan.limits = store.keep(counts.groupBy("source").applyInPandas(cut, "_s string, _c int, _cut int"), "cuts")
    plan.few_limits = plan.limits.limit(FEW + 1).count() <= FEW
    return plan


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.keep(measured(store.table(spark, sf_dir, "documents")), "sizes")
    out = fit(rows).apply(rows)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def free(name: str, taken: list[str]) -> str:
    """``name``, or the first of name_2, name_3, ... that is not taken."""
    low = {c.lower() for c in taken}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(2, len(low) + 3))) if x.lower() not in low)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each copy (column ``copy`` from 1).
    Documents without words are outside the word budget and stay once."""
    store.bound_batches(spark)
    out = fit(store.keep(measured(docs), "sizes")).apply(measured(docs, row=True)).where("copies > 0")
    return out.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(free("copy", docs.columns)))


#: size, source_size and target of each document, in SQL: sources that are capped come first
#: by their cap over their weight, and what is left is shared by the others.
TARGETS_SQL = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, 1.5e0 * sum(words) OVER () AS budget FROM s),
c AS (SELECT *, 2e0 * words / weight AS cap, row_number() OVER (ORDER BY 2e0 * words / weight, source NULLS LAST) AS nth FROM w),
f AS (SELECT *, coalesce(sum(2e0 * words) OVER o, 0e0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0e0) AS rest FROM c WINDOW o AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, (budget - used) / rest AS share FROM f),
l AS (SELECT min(share) FILTER (WHERE share < cap) AS level, min(nth) FILTER (WHERE share < cap) AS from_ FROM k),
m AS (SELECT source, words, CASE WHEN from_ IS NOT NULL AND nth >= from_ THEN weight * (SELECT share FROM k WHERE nth = from_) ELSE 2e0 * words END AS target FROM k, l)
SELECT d.doc_id, d.size, m.words AS source_size, round(m.target, 3) + 0e0 AS target FROM d JOIN m ON m.source IS NOT DISTINCT FROM d.source
"""


def target_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can give, from op4."""
    return op4(spark, sf_dir).select("doc_id", "size", "source_size", (F.round("target", 3) + F.lit(0.0)).alias("target"))
