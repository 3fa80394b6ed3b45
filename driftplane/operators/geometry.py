"""Geometry kinds, crossings and wrapping, over rows of lines and rings of unit vectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sphere as S
from . import shared

_POINTS = "array<struct<x: double, y: double, z: double>>"


def to_multipoint(rings: Column, holes: bool = True) -> Column:
    """All points of a geometry; without those of holes if asked."""
    return F.flatten(rings) if holes else F.element_at(rings, 1)


def to_polyline(rings: Column, gtype: Column, holes: bool = True) -> Column:
    """A polyline; a polygon's exterior is closed.  Null for points, and for polygons with
    holes if these are excluded."""
    first = F.element_at(rings, 1)
    closed = F.concat(first, F.slice(first, F.lit(1), F.lit(1)))
    line = F.when(gtype == "polygon", closed).otherwise(first)
    bad = (F.size(line) < 2) | ((gtype == "polygon") & (F.size(rings) > 1) & F.lit(not holes))
    return F.when(~bad, line)


def to_polygon(rings: Column, gtype: Column) -> Column:
    """Rings of a polygon; null with fewer than three points."""
    first = F.element_at(rings, 1)
    closed = (F.size(first) > 3) & (F.element_at(first, 1) == F.element_at(first, -1))
    ring = F.when(closed, F.slice(first, F.lit(1), F.size(first) - 1)).otherwise(first)
    return F.when(gtype == "polygon", rings).when(F.size(ring) >= 3, F.array(ring))


def force_orientation(rings: Column, clockwise: bool, holes_opposite: bool = True) -> Column:
    first = F.array(S.oriented(F.element_at(rings, 1), clockwise))
    rest = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return F.concat(first, F.transform(rest, lambda r: S.oriented(r, clockwise != holes_opposite)))


def concatenated(a: Column, b: Column) -> Column:
    """Two polylines as one; a shared end is kept once."""
    return F.when(F.element_at(a, -1) == F.element_at(b, 1), F.concat(a, F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))))).otherwise(F.concat(a, b))


def segments(lines: DataFrame, key: str = "id", line: str = "line") -> DataFrame:
    """(key, seg, a, b): the arcs of polylines, a row each."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    arcs = F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return lines.select(key, F.posexplode(arcs).alias("seg", "s")).select(key, "seg", F.col("s.a").alias("a"), F.col("s.b").alias("b"))


def _in_cells(segs: DataFrame, size: float) -> DataFrame:
    """Segments in every cube that they pass, by points of them half a cube apart."""
    pts = S.tessellate(F.col("a"), F.col("b"), size / 2)
    around = [F.array(*[F.lit(x) for x in (-1, 0, 1)])] * 3
    near = F.flatten(F.flatten(F.transform(around[0], lambda i: F.transform(around[1], lambda j: F.transform(around[2], lambda k: F.struct(i.alias("i"), j.alias("j"), k.alias("k")))))))
    home = F.array_distinct(F.transform(pts, lambda p: S.cell(p, size)))
    grown = F.array_distinct(F.flatten(F.transform(home, lambda c: F.transform(near, lambda d: F.struct((c["i"] + d["i"]).alias("i"), (c["j"] + d["j"]).alias("j"), (c["k"] + d["k"]).alias("k"))))))
    return segs.withColumn("_home", home).withColumn("_grown", grown)


#: Arcs of the second table that are broadcast at most.
FEW_ARCS = 50_000


def crossings(left: DataFrame, right: DataFrame, *, cell: float = 0.05, few: int = FEW_ARCS) -> DataFrame:
    """(left_id, left_seg, right_id, right_seg, p): where arcs of two tables of segments (id,
    seg, a, b) cross.  Arcs meet in cubes, by equi-join; each pair is reported once."""
    a = _in_cells(left, cell).select(F.col("id").alias("left_id"), F.col("seg").alias("left_seg"), F.col("a").alias("a1"), F.col("b").alias("b1"), F.explode("_home").alias("_c"))
    b = _in_cells(right, cell).select(F.col("id").alias("right_id"), F.col("seg").alias("right_seg"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.explode("_grown").alias("_d"))
    # few arcs are broadcast: else all that pass one cell of theirs would be one task
    b = F.broadcast(b) if right.count() <= few else b
    pairs = a.join(b, F.col("_c") == F.col("_d")).where(S.arcs_cross(F.col("a1"), F.col("b1"), F.col("a2"), F.col("b2")))
    found = pairs.withColumn("p", S.arc_intersection(F.col("a1"), F.col("b1"), F.col("a2"), F.col("b2")))
    return found.select("left_id", "left_seg", "right_id", "right_seg", "p").distinct()


def self_crossings(lines: DataFrame, key: str = "id", **options) -> DataFrame:
    """Crossings of each polyline with itself."""
    s = segments(lines.withColumnRenamed(key, "id"), "id")
    return crossings(s, s, **options).where("left_id = right_id and left_seg < right_seg")


def intersection_graph(lines: DataFrame, others: DataFrame, key: str = "id", **options) -> DataFrame:
    """(key, nth, from_other, to_other, points): polylines (key, line) cut at every crossing with
    other ones, in order along them, with the others that cut each end (null at a line's own
    ends).  A line without a crossing is one piece."""
    lines = shared.spread(lines)
    found = crossings(segments(lines.withColumnRenamed(key, "id")), segments(others.withColumnRenamed(key, "id")), **options)
    cuts = found.groupBy("left_id").agg(F.collect_list(F.struct("left_seg", "right_id", "p")).alias("cuts"))
    # what a line and its cuts hold is little, what is done with them is not: no task takes them all
    rows = shared.spread(lines.select(key, "line").join(cuts, F.col(key) == F.col("left_id"), "left").select(key, "line", "cuts"))
    kinds = dict(lines.dtypes)[key], dict(others.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        from . import topology

        point = pa.struct([(c, pa.float64()) for c in "xyz"])
        at = lambda p: np.array([p[c] for c in "xyz"])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                line = np.array([at(p) for p in row["line"]])
                places = [(0.0, None)]
                for c in row["cuts"] or []:
                    a, b = line[c["left_seg"]], line[c["left_seg"] + 1]
                    whole = float(np.arccos(np.clip(a @ b, -1, 1)))
                    places.append((c["left_seg"] + float(np.arccos(np.clip(a @ at(c["p"]), -1, 1))) / max(whole, 1e-15), c["right_id"]))
                places = sorted([*places, (float(len(line) - 1), None)], key=lambda x: (x[0], x[1] is not None, str(x[1])))
                for n, ((lo, x), (hi, y)) in enumerate(zip(places, places[1:], strict=False)):
                    part = topology.part_of(line, lo, hi)
                    out.append((row[key], n, x, y, [dict(zip("xyz", map(float, p), strict=True)) for p in part]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [batch.schema.field(key).type, pa.int32(), other_type, other_type, pa.list_(point)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "nth", "from_other", "to_other", "points"])

    from pyspark.sql.pandas.types import to_arrow_type

    other_type = to_arrow_type(others.schema[key].dataType)
    return rows.mapInArrow(run, f"{key} {kinds[0]}, nth int, from_other {kinds[1]}, to_other {kinds[1]}, points {_POINTS}")


def split_at_dateline(coordinates: list[tuple[float, float]], centre: float = 0.0) -> list[list[tuple[float, float]]]:
    """A (lat, lon) line cut where it passes the meridian opposite ``centre``; the cut points
    are on both sides of it."""
    lo = centre - 180.0
    out: list[list[tuple[float, float]]] = []
    wrap = lambda x: (x - lo) % 360.0 + lo
    for lat, lon in coordinates:
        lon = wrap(lon)
        if not out:
            out.append([(lat, lon)])
            continue
        before = out[-1][-1]
        if abs(lon - before[1]) <= 180:
            out[-1].append((lat, lon))
            continue
        east = before[1] > lon
        edge, other = (lo + 360, lo) if east else (lo, lo + 360)
        at = _latitude_at(before, (lat, lon), edge)
        if before != (at, edge):
            out[-1].append((at, edge))
        out.append([(at, other), (lat, lon)] if (lat, lon) != (at, other) else [(lat, lon)])
    return out


def _latitude_at(p: tuple[float, float], q: tuple[float, float], lon: float) -> float:
    """Latitude at which the arc p-q passes a meridian."""
    v = [np.array([math.cos(math.radians(a)) * math.cos(math.radians(o)), math.cos(math.radians(a)) * math.sin(math.radians(o)), math.sin(math.radians(a))]) for a, o in (p, q)]
    n = np.cross(v[0], v[1])
    m = np.array([-math.sin(math.radians(lon)), math.cos(math.radians(lon)), 0.0])
    at = np.cross(n, m)
    if np.linalg.norm(at) < 1e-12:
        return p[0]
    at /= np.linalg.norm(at)
    at = at if at @ (v[0] + v[1]) > 0 else -at
    return math.degrees(math.asin(max(-1.0, min(1.0, at[2]))))


def wrap_dateline(lines: DataFrame, key: str = "id", centre: float = 0.0) -> DataFrame:
    """(id, part, coordinates) of lines (id, coordinates: array of lat, lon), cut at the date
    line, in batches of rows."""
    kind = dict(lines.dtypes)[key]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(k, i, [{"lat": a, "lon": o} for a, o in part]) for k, line in zip(frame[key], frame["coordinates"], strict=True) if line is not None for i, part in enumerate(split_at_dateline([(p["lat"], p["lon"]) for p in line], centre))]
            yield pd.DataFrame(rows, columns=[key, "part", "coordinates"])

    return lines.select(key, "coordinates").mapInPandas(run, f"{key} {kind}, part int, coordinates array<struct<lat: double, lon: double>>")


def resampled(line: Column, n: int) -> Column:
    """n + 1 points of a polyline at equal fractions of its length."""
    k = F.greatest(F.size(line) - 1, F.lit(1))
    a, b = F.slice(line, F.lit(1), k), F.slice(line, F.lit(2), F.greatest(k, F.lit(1)))
    steps = F.zip_with(a, b, lambda p, q: S.angle(p, q))
    ends = F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def at(i: Column) -> Column:
        target = F.element_at(ends, -1) * i / n
        seg = F.greatest(F.lit(1), F.least(k, F.size(F.filter(ends, lambda x: x <= target + 1e-15))))
        part = (target - F.element_at(ends, seg)) / F.greatest(F.element_at(steps, seg), F.lit(1e-15))
        return S.arc_point(F.element_at(line, seg), F.element_at(line, seg + 1), F.least(F.lit(1.0), part))

    return F.transform(F.sequence(F.lit(0), F.lit(n)), at)


def interpolated_lines(pairs: DataFrame, ratios: list[float], points: int = 32) -> DataFrame:
    """Lines between ``from_line`` and ``to_line`` at ratios: both are resampled, and points
    of one rank joined by arcs."""
    rows = pairs.withColumn("_a", resampled(F.col("from_line"), points)).withColumn("_b", resampled(F.col("to_line"), points))
    rows = rows.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    return rows.withColumn("line", F.zip_with("_a", "_b", lambda p, q: S.arc_point(p, q, F.col("ratio")))).drop("_a", "_b")
