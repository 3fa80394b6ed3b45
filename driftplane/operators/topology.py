"""Topologies: lines, boundaries and networks assembled from reconstructed sections.

Sections are rows (topology_id, time, section_index, feature_id, reverse, is_interior);
geometries are rows (time, feature_id, line).  Sections join geometries on (time, feature).
They are resolved in three passes (:func:`resolve`): topological lines, then boundaries and
networks, whose sections may be such lines.  A topology's sections are one bounded list (a
plate boundary has tens of sections), assembled by a numpy kernel in a grouped Arrow
function; rows of different topologies and times are independent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sphere as S
from . import cutting, mesh, shared

_POINTS = "array<struct<x: double, y: double, z: double>>"


def resolve_sections(sections: DataFrame, geometries: DataFrame) -> DataFrame:
    """Sections with their geometry at each time; a feature without geometry at that time
    drops its section, one with several is taken by its least line."""
    one = geometries.groupBy("time", "feature_id").agg(F.min("line").alias("line"))
    return sections.join(one, ["time", "feature_id"])


def referenced(sections: DataFrame) -> DataFrame:
    """Features that topologies depend on."""
    return sections.select("feature_id").distinct()


def _crossing(a: np.ndarray, b: np.ndarray) -> list[tuple[float, float, np.ndarray]]:
    """(place on a, place on b, point) of the crossings of two polylines, along a.  A place is
    the number of a segment and the fraction of it."""
    if len(a) < 2 or len(b) < 2:
        return []
    i, j, p = cutting.meetings(a[:-1], a[1:], b[:-1], b[1:])

    def place(line: np.ndarray, k: np.ndarray) -> np.ndarray:
        far = lambda x, y: np.arccos(np.clip((x * y).sum(1), -1, 1))
        return k + np.clip(far(line[k], p) / np.maximum(far(line[k], line[k + 1]), 1e-15), 0, 1 - 1e-12)

    return sorted(zip(place(a, i).tolist(), place(b, j).tolist(), p, strict=True), key=lambda c: c[0]) if len(i) else []


def _pick(found: list, before: float | None, backwards: bool, after: float | None):
    """Of several crossings of a section with the one before it, the first along the earlier
    section that is on the side of its own first cut where the boundary goes on (its tail,
    or its head if it runs backwards), and on the current section's head.  ``before``: where
    the earlier section is cut already; ``after``: where the current one is."""
    head, tail = lambda x, cut: x <= cut, lambda x, cut: x >= cut
    whole = lambda x, cut: True
    earlier = [(whole, 0.0)] if before is None else [(head, before), (tail, before)] if backwards else [(tail, before), (head, before)]
    current = [(whole, 0.0)] if after is None else [(head, after), (tail, after)]
    for on_current, cut_c in current:
        for on_earlier, cut_e in earlier:
            for c in found:
                if on_earlier(c[0], cut_e) and on_current(c[1], cut_c):
                    return c
    return None


@dataclass
class Piece:
    """The part of a section that a topology uses: places on it, points in the section's own
    direction, and whether the topology runs through it backwards."""

    lo: float
    hi: float
    points: np.ndarray
    backwards: bool


def part_of(line: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The points of a line from one place to another."""

    def at(x: float) -> np.ndarray:
        k = min(int(np.floor(x)), len(line) - 2) if len(line) > 1 else 0
        f = x - k
        if len(line) < 2 or f <= 0:
            return line[k]
        if f >= 1:
            return line[k + 1]
        w = float(np.arccos(np.clip(line[k] @ line[k + 1], -1, 1)))
        return line[k] if w < 1e-15 else (np.sin((1 - f) * w) * line[k] + np.sin(f * w) * line[k + 1]) / np.sin(w)

    inner = [line[k] for k in range(int(np.floor(lo)) + 1, int(np.ceil(hi))) if lo < k < hi]
    return np.array([at(lo), *inner, at(hi)])


def pieces(sections: list[np.ndarray], reverse: list[bool], closed: bool = True) -> list[Piece]:
    """The parts of sections between their meetings with the sections before and after.

    A section without a meeting on a side keeps its end there, and the gap is bridged by the
    topology itself; with one meeting it keeps the part on the far side of it in its
    direction.  Two meetings give the direction.  The two sections of a closed topology of
    two meet twice."""
    n = len(sections)
    first: list[float | None] = [None] * n  # where each is cut by the one before
    last: list[float | None] = [None] * n
    if n == 2 and closed:
        found = _crossing(sections[0], sections[1])
        if len(found) >= 2:
            x, y = found[:2] if not reverse[0] else found[1::-1]
            first[0], last[0], first[1], last[1] = x[0], y[0], y[1], x[1]
        elif found:
            last[0], first[1] = found[0][:2]
    elif n > 1:
        for k in range(1, n + (1 if closed else 0)):
            e, c = k - 1, k % n
            got = _pick(_crossing(sections[e], sections[c]), first[e], reverse[e], last[c])
            if got is not None:
                last[e], first[c] = got[0], got[1]
    out = []
    for line, back, x, y in zip(sections, reverse, first, last, strict=True):
        end = float(max(len(line) - 1, 0))
        if x is not None and y is not None:
            back = x > y if x != y else back
            lo, hi = min(x, y), max(x, y)
        elif x is not None:
            lo, hi = (0.0, x) if back else (x, end)
        elif y is not None:
            lo, hi = (y, end) if back else (0.0, y)
        else:
            lo, hi = 0.0, end
        out.append(Piece(lo, hi, part_of(line, lo, hi) if end else line, back))
    return out


def assemble(sections: list[np.ndarray], reverse: list[bool], closed: bool = True) -> np.ndarray:
    """Boundary ring (or open line): the sections' parts head to tail."""
    parts = [p.points[::-1] if p.backwards else p.points for p in pieces(sections, reverse, closed)]
    ring = np.vstack(parts)
    keep = np.ones(len(ring), bool)
    keep[1:] = np.abs(ring[1:] - ring[:-1]).sum(1) > 1e-12
    ring = ring[keep]
    return ring[:-1] if closed and len(ring) > 1 and np.abs(ring[0] - ring[-1]).sum() <= 1e-12 else ring


def _arrays(frame):
    frame = frame.sort_values("section_index")
    return [np.array([[p["x"], p["y"], p["z"]] for p in line]) for line in frame["line"]], [bool(r) for r in frame["reverse"]]


def _rows(ring: np.ndarray) -> list[dict]:
    return [{"x": float(p[0]), "y": float(p[1]), "z": float(p[2])} for p in ring]


def _assembled(resolved: DataFrame, name: str, closed: bool, least: int) -> DataFrame:
    def build(key, frame):
        import pandas as pd

        ring = assemble(*_arrays(frame), closed)
        return pd.DataFrame([(key[0], key[1], _rows(ring))] if len(ring) >= least else [], columns=["time", "topology_id", name])

    edge = resolved.where(~F.coalesce("is_interior", F.lit(False)))
    kind = dict(resolved.dtypes)["topology_id"]
    return edge.groupBy("time", "topology_id").applyInPandas(build, f"time double, topology_id {kind}, {name} {_POINTS}")


def boundaries(resolved: DataFrame) -> DataFrame:
    """(time, topology_id, ring) of closed boundaries; fewer than three points are skipped."""
    return _assembled(resolved, "ring", True, 3)


def lines(resolved: DataFrame) -> DataFrame:
    """(time, topology_id, line) of topological lines, cut where neighbours cross."""
    return _assembled(resolved, "line", False, 2)


def resolve(sections: DataFrame, geometries: DataFrame) -> dict[str, DataFrame]:
    """``lines``, ``boundaries`` and ``networks`` of sections that also have a ``kind`` (line,
    boundary or network).  Lines come first: the others may have them as sections, by the
    line's topology_id as feature_id."""
    of = lambda kind: sections.where(F.col("kind") == kind).drop("kind")
    made = lines(resolve_sections(of("line"), geometries))
    both = geometries.select("time", "feature_id", "line").unionByName(made.select("time", F.col("topology_id").cast(dict(geometries.dtypes)["feature_id"]).alias("feature_id"), "line"))
    return {"lines": made, "boundaries": boundaries(resolve_sections(of("boundary"), both)), "networks": networks(resolve_sections(of("network"), both))}


def sub_segments(resolved: DataFrame) -> DataFrame:
    """(time, topology_id, section_index, feature_id, lo, hi, reverse, line): the part of each
    section that its boundary uses, as places on the section."""
    kinds = dict(resolved.dtypes)

    def build(key, frame):
        import pandas as pd

        frame = frame.sort_values("section_index")
        found = pieces(*_arrays(frame))
        rows = [(key[0], key[1], i, f, p.lo, p.hi, p.backwards, _rows(p.points)) for i, f, p in zip(frame["section_index"], frame["feature_id"], found, strict=True)]
        return pd.DataFrame(rows, columns=["time", "topology_id", "section_index", "feature_id", "lo", "hi", "reverse", "line"])

    edge = resolved.where(~F.coalesce("is_interior", F.lit(False)))
    schema = f"time double, topology_id {kinds['topology_id']}, section_index {kinds['section_index']}, feature_id {kinds['feature_id']}, lo double, hi double, reverse boolean, line {_POINTS}"
    return edge.groupBy("time", "topology_id").applyInPandas(build, schema)


def shared_sub_segments(parts: DataFrame) -> DataFrame:
    """(time, feature_id, lo, hi, topologies, reversed): the longest pieces of each section that
    one set of topologies shares, with which of them run through it backwards.

    Ends of all parts cut a section to elementary pieces; pieces join the parts that hold
    them (rows of one section at one time: the few topologies on its two sides)."""
    ends = parts.select("time", "feature_id", F.explode(F.array("lo", "hi")).alias("at")).distinct()
    by = Window.partitionBy("time", "feature_id").orderBy("at")
    steps = ends.withColumn("to", F.lead("at").over(by)).where("to is not null")
    p = parts.select("time", "feature_id", "topology_id", "reverse", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    held = steps.join(p, ["time", "feature_id"]).where((F.col("_lo") <= F.col("at")) & (F.col("_hi") >= F.col("to")))
    return held.groupBy("time", "feature_id", F.col("at").alias("lo"), F.col("to").alias("hi")).agg(F.array_sort(F.collect_set("topology_id")).alias("topologies"), F.array_sort(F.collect_set(F.when(F.col("reverse"), F.col("topology_id")))).alias("reversed"))


def shared_sections(resolved: DataFrame) -> DataFrame:
    """(time, feature_id, topologies): which topologies share each section."""
    return resolved.groupBy("time", "feature_id").agg(F.array_sort(F.collect_set("topology_id")).alias("topologies"))


def networks(resolved: DataFrame, *, forced: bool = False, strip: int = mesh.STRIP, few: int = mesh.FEW_EDGES) -> DataFrame:
    """(time, topology_id, face, vertices, region, block, centre): the Delaunay faces of boundary
    and interior points, in an equal-area plane about the boundary's middle.

    A face is in the network if its middle is inside the boundary.  It is ``rigid`` and names
    its ``block`` if its middle is inside an interior section marked ``is_block`` (a polygon:
    of several, the least feature), else ``deforming``.  With ``forced``, edges of the boundary
    and of blocks are edges of faces: those that are not are halved until they are.  Boundaries
    of fewer than three points make no network; one that reaches a quarter turn from its middle
    is refused."""
    keys = list(mesh.KEYS)
    rings = boundaries(resolved).withColumn("centre", S.centroid(F.col("ring")))
    rings = shared.settled(rings)
    if not rings.where(F.exists("ring", lambda p: S.dot(p, F.col("centre")) < 1e-6)).isEmpty():
        raise ValueError("a network that reaches a quarter turn from its middle")
    nets = rings.select(*keys, "centre")
    inner = resolved.where(F.coalesce("is_interior", F.lit(False)))
    flagged = F.coalesce("is_block", F.lit(False)) if "is_block" in resolved.columns else F.lit(False)
    blocks = inner.where(flagged & (F.size("line") > 2)).select(*keys, F.col("feature_id").cast("string").alias("name"), F.col("line").alias("ring"))
    outlines = rings.select(*keys, F.lit(None).cast("string").alias("name"), "ring").unionByName(blocks)
    spots = rings.select(*keys, F.explode("ring").alias("v")).unionByName(inner.select(*keys, F.explode("line").alias("v")))
    spots = shared.spread(spots).join(nets, keys)
    points = mesh.once(spots, _p=mesh.in_plane(F.col("v"), F.col("centre"))).select(*keys, "v.x", "v.y", "v.z", "_p.u", "_p.w")
    edges = outlines.join(nets, keys).select(*keys, "name", "centre", F.explode(S._edges(F.col("ring"))).alias("e"))
    if forced:
        full = lambda c: F.struct(*(F.col(f"e.{c}.{k}").alias(k) for k in "xyz"), *(mesh.in_plane(F.col(f"e.{c}"), F.col("centre"))[k].alias(k) for k in "uw"))
        pairs = edges.select(*keys, full("a").alias("a"), full("b").alias("b")).where("a <> b")
        ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        faces = mesh.conforming(points, pairs.select(*keys, *ends).distinct(), nets, strip=strip)
    else:
        faces = mesh.triangulated(points, strip=strip)
    corners = F.array(*(F.struct(*(F.col(f"{k}{i}").alias(k) for k in "xyz")) for i in range(3)))
    number = Window.partitionBy(*keys).orderBy("vertices")
    # numbered when read: a number that nobody asks for costs no sort
    faces = shared.settled(faces.select(*keys, corners.alias("vertices")).join(nets, keys)).withColumn("face", F.row_number().over(number) - 1)
    middle = lambda v: S.normalise(S.add(S.add(v[0], v[1]), v[2]))
    flat = mesh.once(edges, **{f"_{c}": mesh.straight(F.col(f"e.{c}"), F.col("centre")) for c in "ab"})
    flat = shared.settled(flat.select(*keys, F.coalesce("name", F.lit("")).alias("name"), *(F.col(f"_{c}.{k}").alias(f"{k}{i}") for i, c in enumerate("ab") for k in "uw")))
    region = F.when(F.col("block").isNotNull(), "rigid").otherwise("deforming")
    shown = [*keys, "face", "vertices", region.alias("region"), "block", "centre"]
    if (flat.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= few:
        at = mesh.once(faces, _s=mesh.straight(middle([F.element_at("vertices", i) for i in (1, 2, 3)]), F.col("centre"))).select(*faces.columns, "_s.u", "_s.w").where("u is not null")
        found = mesh.held_by_few(at, flat)
        block = F.array_min(F.filter("_names", lambda n: n != ""))
        return found.where(F.array_contains("_names", "")).withColumn("block", block).select(*shown)
    faces = shared.settled(faces)
    at = mesh.once(faces, _s=mesh.straight(middle([F.element_at("vertices", i) for i in (1, 2, 3)]), F.col("centre"))).select(*keys, "face", "_s.u", "_s.w").where("u is not null")
    held = mesh.held(at, flat, point="face").groupBy(*keys, "face").agg(F.max(F.col("name") == "").alias("inside"), F.min(F.when(F.col("name") != "", F.col("name"))).alias("block")).where("inside")
    return faces.join(held, [*keys, "face"]).select(*shown)


def barycentric(p, a, b, c):
    """Weights of three vertices at a point in their triangle, by areas; they sum to one."""
    whole = S.triangle_area(a, b, c)
    wa, wb = S.triangle_area(p, b, c) / whole, S.triangle_area(a, p, c) / whole
    return F.struct(wa.alias("a"), wb.alias("b"), (1 - wa - wb).alias("c"))


def located(points: DataFrame, faces: DataFrame, key: str = "id") -> DataFrame:
    """Points with the network face that holds them (the first by topology and face)."""
    from . import partition

    f = _about(points, faces).withColumn("plate_id", F.struct("topology_id", "face")).withColumn("rings", F.array("vertices")).withColumn("priority", F.struct("topology_id", "face"))
    return partition.first_hit(points, f.select("plate_id", "rings", "priority"), key=key)


#: Level of the cells (two to the level, of the unit sphere) by which faces without points go.
COARSE = -7


def _about(points: DataFrame, faces: DataFrame) -> DataFrame:
    """The faces in whose cells there are points, and all that are larger than a cell.  The sphere
    has a few hundred thousand cells, whatever the points and faces."""
    at = F.lit(COARSE)
    held = points.select(mesh.cell([F.col("v")[c] for c in "xyz"], at).alias("_cell")).distinct()
    axis = lambda of, c: of(*(F.element_at("vertices", i)[c] for i in (1, 2, 3)))
    size = F.greatest(*(axis(F.greatest, c) - axis(F.least, c) for c in "xyz"))
    f = faces.withColumn("_large", size > 2.0**COARSE / 4)
    # an edge swells out from its chord by less than a tenth of so small a face
    pad = size / 10 + 1e-9
    low, high = ([axis(of, c) + s * pad for c in "xyz"] for of, s in ((F.least, -1), (F.greatest, 1)))
    near = f.where("not _large").withColumn("_cell", F.explode(mesh.cells(low, high, at))).join(F.broadcast(held), "_cell", "left_semi").drop("_cell")
    near = near.dropDuplicates(["topology_id", "face"])
    return shared.settled(near.unionByName(f.where("_large")).drop("_large"))


def locate(points: DataFrame, outlines: DataFrame, blocks: DataFrame, key: str = "id") -> DataFrame:
    """Points with ``topology_id``, ``region`` and ``block``: the first network (topology_id, ring)
    by its id that holds them, ``rigid`` with the least block (topology_id, block, ring) of
    that network that holds them, else ``deforming``; ``outside`` where no network does."""
    from . import partition

    shape = lambda df, hit: df.select(hit.alias("plate_id"), F.array("ring").alias("rings"), hit.alias("priority"))
    net = partition.first_hit(points, shape(outlines, F.col("topology_id")), key=key).withColumnRenamed("hit", "topology_id")
    within = partition.hits(net.where("topology_id is not null").select(key, "v", F.col("topology_id").alias("_t")), shape(blocks, F.struct("topology_id", "block")))
    rigid = within.where("hit.topology_id = _t").groupBy(key).agg(F.min("hit.block").alias("block"))
    region = F.when(F.col("topology_id").isNull(), "outside").when(F.col("block").isNotNull(), "rigid").otherwise("deforming")
    return net.join(rigid, key, "left").withColumn("region", region)


#: How strain rates vary over a network: constant in faces, or smoothed from its vertices.
SMOOTHING = ("none", "barycentric", "natural_neighbour")


def vertex_gradients(faces: DataFrame) -> DataFrame:
    """(topology_id, vertex, g): the area-weighted mean gradient of the faces at each vertex, of
    faces (topology_id, vertices, g)."""
    fields = ("tt", "tp", "pt", "pp")
    area = F.abs(S.triangle_area(F.element_at("vertices", 1), F.element_at("vertices", 2), F.element_at("vertices", 3)))
    rows = faces.select("topology_id", "g", "vertices", area.alias("_a")).select("topology_id", "g", "_a", F.explode("vertices").alias("vertex"))
    mean = F.struct(*((F.sum(F.col(f"g.{c}") * F.col("_a")) / F.sum("_a")).alias(c) for c in fields))
    return rows.groupBy("topology_id", "vertex").agg(mean.alias("g"))


def _centres(faces: DataFrame) -> DataFrame:
    """(topology_id, centre): the mean of each network's vertices."""
    each = faces.select("topology_id", F.explode("vertices").alias("p")).distinct()
    return each.groupBy("topology_id").agg(S.normalise(F.struct(*(F.avg(f"p.{c}").alias(c) for c in "xyz"))).alias("centre"))


def strain_at(points: DataFrame, faces: DataFrame, smoothing: str = "natural_neighbour", key: str = "id") -> DataFrame:
    """Points (id, v) in a network's faces (topology_id, face, vertices, g) with the gradient
    there: the face's, or that of vertices by barycentric or natural-neighbour weights.  Points
    of one place are worked out once."""
    if smoothing not in SMOOTHING:
        raise ValueError(f"smoothing is one of {SMOOTHING}")
    places = points.select("v").distinct().withColumn(key, F.xxhash64("v"))
    return points.select(key, "v").join(_strain_of(places, faces, smoothing, key).select("v", "g"), "v").select(key, "v", "g")


def _strain_of(points: DataFrame, faces: DataFrame, smoothing: str, key: str) -> DataFrame:
    hit = located(points, faces, key=key).where("hit is not null").select(key, "v", "hit.topology_id", "hit.face")
    inside = hit.join(faces.select("topology_id", "face", "vertices", F.col("g").alias("_face_g")), ["topology_id", "face"])
    if smoothing == "none":
        return inside.select(key, "v", F.col("_face_g").alias("g"))
    at = vertex_gradients(faces)
    fields = ("tt", "tp", "pt", "pp")
    if smoothing == "barycentric":
        corner = [F.element_at("vertices", i) for i in (1, 2, 3)]
        w = inside.withColumn("_w", barycentric(F.col("v"), *corner))
        rows = w.select(key, "v", "topology_id", F.explode(F.array(*(F.struct(c.alias("vertex"), F.col(f"_w.{n}").alias("w")) for c, n in zip(corner, "abc", strict=True)))).alias("e"))
        rows = rows.select(key, "v", "topology_id", "e.vertex", "e.w")
    else:
        rows = mesh.natural_rows(inside, faces if "centre" in faces.columns else faces.join(_centres(faces), "topology_id"), key)
    joined = rows.join(at, ["topology_id", "vertex"])
    return joined.groupBy(key, "v").agg(F.struct(*(F.sum(F.col("w") * F.col(f"g.{c}")).alias(c) for c in fields)).alias("g"))
