"""Regions around seeds as blocks: the distances of a block of seeds from a block of targets
are one array, and only what a block's targets give each seed leaves the task.

Targets are in one cube of the unit sphere, seeds in the cubes that their region touches; a
cube's seeds and targets are dealt to blocks of ``ROWS`` at most, and every pair of blocks is
one group of a cogroup.  So pairs are never rows, and what is shuffled grows with the sites.
Dot products are summed in the order of :func:`.sphere.dot`; distances leave as dot products."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sphere as S

#: Seeds, and targets, of a block at most; pairs that are worked on at once.
ROWS, PAIRS = 8192, 1 << 16
#: Dot products so near that of the region's rim are decided by their arc cosine.
RIM = 1e-9
PLACE = ("_x", "_y", "_z")


@dataclass(frozen=True)
class Part:
    """What seeds get of the targets nearer than ``km``: ``op`` sum, min or max of a column of
    numbers; ``km_sum`` of a column times the distance; ``dot_min``, ``dot_max`` of the dot
    products; ``rank``: the column's value at the place ``_at`` of each seed, counted from 1, in
    ascending order, every target ``_times`` there."""

    name: str
    op: str
    km: float
    column: str | None = None

    def merged(self) -> Column:
        of = {"min": F.min, "dot_min": F.min, "max": F.max, "dot_max": F.max, "rank": F.max}.get(self.op, F.sum)
        return of(self.name).alias(self.name)


def _reduce(part: Part, dot: np.ndarray, near: np.ndarray, held: dict, radius: float) -> np.ndarray:
    """One number a seed; NaN where there is none (sums: 0), codes for min and max."""
    if part.op == "dot_max":
        return np.where(near, dot, -np.inf).max(axis=1)
    if part.op == "dot_min":
        return np.where(near, dot, np.inf).min(axis=1)
    if part.op == "sum":
        return np.where(near, held[part.column], 0.0).sum(axis=1)
    if part.op == "km_sum":
        return np.where(near, np.arccos(np.clip(dot, -1.0, 1.0)) * radius * held[part.column], 0.0).sum(axis=1)
    codes, none = held[part.op, part.column]
    found = np.where(near, codes, none)
    return found.max(axis=1) if part.op == "max" else found.min(axis=1)


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null) and which are null."""
    return column.fill_null(0.0).to_numpy(), column.is_null().to_numpy()


def _held(parts: list[Part], right: pa.Table) -> tuple[dict, dict]:
    """Columns as arrays: sums skip nulls; min and max go by codes in the order of the values,
    in which NaN is the greatest, as it is to Spark."""
    held, values = {}, {}
    for p in parts:
        if p.column is None or p.op == "rank":
            continue
        x, null = _numbers(right[p.column])
        if p.op in ("sum", "km_sum"):
            held[p.column] = x
        else:
            values[p.column], codes = np.unique(x, return_inverse=True)
            none = -1 if p.op == "max" else len(x)
            held[p.op, p.column] = np.where(null, none, codes).astype(np.int32), np.int32(none)
    return held, values


def _block(parts: list[Part], radius: float, keep: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, m = left.num_rows, right.num_rows
        if not n or not m:
            return pa.table({"_s": left["_s"].slice(0, 0), **{c: right[c].slice(0, 0) for c in keep}, **{p.name: pa.array([], pa.float64()) for p in parts}})
        ranks = [p for p in parts if p.op == "rank"]
        if ranks:
            right = right.take(pa.array(np.argsort(right[ranks[0].column].to_numpy(), kind="stable")))
        s, t = ([df[c].to_numpy() for c in PLACE] for df in (left, right))
        held, values = _held(parts, right)
        out = {p.name: np.empty(n, np.float64) for p in parts}
        step = max(1, PAIRS // m)
        for lo in range(0, n, step):
            at = slice(lo, lo + step)
            dot = s[0][at, None] * t[0]
            dot += s[1][at, None] * t[1]
            dot += s[2][at, None] * t[2]
            masks = {}
            for p in parts:
                if p.km not in masks:
                    rim = math.cos(min(p.km / radius, math.pi))
                    near = dot > rim + RIM
                    close = np.nonzero((dot <= rim + RIM) & (dot >= rim - RIM))
                    if len(close[0]):
                        near[close] = np.arccos(np.clip(dot[close], -1.0, 1.0)) * radius < min(p.km, math.pi * radius)
                    masks[p.km] = near
                if p.op == "rank":
                    upto = np.where(masks[p.km], right["_times"].to_numpy(), 0).cumsum(axis=1)
                    out[p.name][at] = right[p.column].to_numpy()[(upto >= left["_at"].to_numpy()[at, None]).argmax(axis=1)]
                else:
                    out[p.name][at] = _reduce(p, dot, masks[p.km], held, radius)
        made, some = {}, np.zeros(n, bool)
        for p in parts:
            x, none = out[p.name], np.zeros(n, bool)
            if p.op in ("min", "max"):
                none = x == held[p.op, p.column][1]
                x = values[p.column][np.where(none, 0, x).astype(np.int64)]
            elif p.op in ("dot_min", "dot_max"):
                none = np.isinf(x)
            made[p.name] = pa.array(x, mask=none)
            some |= ~none & (x != 0 if p.op in ("sum", "km_sum") else True)
        # rows that tell nothing are not shuffled
        rows = pa.table({"_s": left["_s"], **{c: pa.array([right[c][0].as_py()] * n, right[c].type) for c in keep}, **made})
        return rows.filter(pa.array(some))

    return run


def swept(seeds: DataFrame, targets: DataFrame, range_km: float, parts: list[Part], *, on: tuple[str, ...] = (), chunk: str | None = None, radius: float = S.EQUATORIAL_RADIUS) -> DataFrame:
    """(_s, [chunk,] a number for each of ``parts``) of seeds (_s, v) over targets (v and the
    parts' columns) nearer than ``range_km`` and equal in ``on``.

    Seeds without targets have no row.  Targets of one ``chunk`` make rows of their own."""
    reach = min(range_km / radius, math.pi)
    chord = 2 * math.sin(reach / 2) if reach < math.pi else 2.0
    size = max(chord, 0.02)
    steps = range(-math.ceil(chord / size), math.ceil(chord / size) + 1)
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in steps for j in steps for k in steps))
    cubes = [(F.col(f"_c.{c}") + F.col(f"_d.{c}")).alias(f"_{c}") for c in "ijk"]
    gap = lambda c, x: F.greatest(F.col(f"_d.{c}") + F.col(f"_c.{c}") - F.col(x) / size, F.col(x) / size - F.col(f"_c.{c}") - F.col(f"_d.{c}") - 1, F.lit(0.0))

    def placed(df: DataFrame, columns: list[Column], copied: bool) -> DataFrame:
        """Rows in their cube, or in all that their region touches."""
        names = df.select(*columns).columns
        df = df.select(*columns, *(F.col("v")[c[1:]].alias(c) for c in PLACE), S.cell(F.col("v"), size).alias("_c"))
        if not copied:
            return df.select(*names, *PLACE, *(F.col(f"_c.{c}").alias(f"_{c}") for c in "ijk"))
        df = df.withColumn("_d", F.explode(around)).where(sum(F.pow(gap(c, x), 2) for c, x in zip("ijk", PLACE, strict=True)) <= (chord / size) ** 2 + 1e-6)
        return df.select(*names, *PLACE, *cubes)

    ranks = ["_at"] if any(p.op == "rank" for p in parts) else []
    columns = dict.fromkeys([p.column for p in parts if p.column is not None] + (["_times"] if ranks else []))
    # a rank needs all targets of a seed in one block: they are copied, else the seeds
    s = placed(seeds, [F.col(c) for c in ("_s", *on, *ranks)], not ranks)
    t = placed(targets, [F.col(c) for c in on] + [F.col(c).cast("double").alias(c) for c in columns] + ([F.col(chunk)] if chunk else []), bool(ranks))
    keys = [*on, "_i", "_j", "_k"]
    dealt = lambda n: F.greatest(F.lit(1), F.ceil(n / ROWS)).cast("int")
    of_seeds = s.groupBy(*keys).agg(dealt(F.count("*")).alias("_blocks"))
    if chunk is not None:
        chunks = t.groupBy(*keys).agg(F.collect_set(chunk).alias("_chunks"))
        t = t.withColumn("_chunk", F.col(chunk))
    else:
        n = F.lit(1) if ranks else dealt(F.count("*"))
        chunks = t.groupBy(*keys).agg(n.alias("_of")).select(*keys, F.sequence(F.lit(0), F.col("_of") - 1).alias("_chunks"))
        t = t.join(chunks.select(*keys, F.size("_chunks").alias("_of")), keys).withColumn("_chunk", F.pmod(F.hash(*PLACE), F.col("_of"))).drop("_of")
    s = s.join(chunks, keys).withColumn("_chunk", F.explode("_chunks")).drop("_chunks")
    s = s.join(of_seeds, keys).withColumn("_block", F.pmod(F.hash("_s"), F.col("_blocks"))).drop("_blocks")
    t = t.join(of_seeds, keys).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    by, keep = [*keys, "_block", "_chunk"], [chunk] if chunk else []
    kinds = dict(s.dtypes) | dict(t.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("_s", *keep)) + "".join(f", `{p.name}` double" for p in parts)
    rows = s.groupBy(*by).cogroup(t.groupBy(*by)).applyInArrow(_block(parts, radius, keep), schema)
    return rows.groupBy("_s", *keep).agg(*(p.merged() for p in parts))
