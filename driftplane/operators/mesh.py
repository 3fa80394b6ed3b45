"""Triangulated networks: Delaunay faces, forced edges, rigid blocks, location, weights.

A network's points lie in a plane (equal-area, about the network's middle).  They are dealt
to slices of about ``STRIP`` points; ``OWN`` slices are a strip, which also knows the slice on
either side, and every strip is triangulated by itself.  A face is final if the circle through its corners lies within what its strip
knows, for then no other point is in it.  What is left open are the surroundings of wide
circles, at the hull and across gaps; it is bounded by edges of one final face, and a second
pass triangulates the points of these edges and keeps the faces on their open side.  So a
network of any size is many tasks, and a small one is a single strip.

Points on one circle have several triangulations; all passes take the same one, because
each point is moved by 1e-11 radians at most, by a hash of its place.

Faces are found by cells whose size follows the face's (:func:`cells`), an equi-join on level
and place; natural-neighbour weights come from the faces whose circles hold a point, found in
the same way, as sums over faces (:func:`natural_rows`), without any gathering by point.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sphere as S
from . import shared

#: Points of a slice, about; slices of a network at most; slices that a strip has of its own.
STRIP, STRIPS, OWN = 2000, 256, 8
#: What lies within so little of a line is no face, and the greatest move of a point.
THIN, MOVE = 1e-10, 1e-11
KEYS = ("time", "topology_id")
_POINT = ("x", "y", "z", "u", "w")
_GHOST = -1


def _moved(p: np.ndarray) -> np.ndarray:
    """Points (n, 2) with their moves: a pure function of each point's place."""
    bits = np.ascontiguousarray(p + 0.0).view(np.uint64)
    h = (bits[:, :1] * np.uint64(0x9E3779B97F4A7C15)) ^ (bits[:, 1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    h = np.concatenate([h, h * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)], 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xA0761D6478BD642F)
    return p + ((h >> np.uint64(11)).astype(float) / 2.0**53 - 0.5) * MOVE


def delaunay(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise triangles (k, 3) of different points of a plane.

    Points are put in one by one, in bands to and fro, so the next is near the last: its
    triangle is found by walking over neighbours, those whose circles hold it go, and it is
    joined to the edges of the hole.  A triangle is three directed edges with their third
    corner; beyond the hull that corner is a ghost."""
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    p = _moved(np.asarray(points, float))
    span = np.maximum(np.ptp(p, axis=0), 1e-300)
    bands = max(1, int(math.sqrt(n / 2)))
    band = np.minimum(((p[:, 0] - p[:, 0].min()) / span[0] * bands).astype(int), bands - 1)
    order = np.lexsort((np.where(band % 2, -p[:, 1], p[:, 1]), band)).tolist()
    xs, ys = p[:, 0].tolist(), p[:, 1].tolist()
    apex: dict[tuple[int, int], int] = {}

    def turn(a: int, b: int, c: int) -> float:
        return (xs[b] - xs[a]) * (ys[c] - ys[a]) - (ys[b] - ys[a]) * (xs[c] - xs[a])

    def put(a: int, b: int, c: int) -> None:
        apex[a, b], apex[b, c], apex[c, a] = c, a, b

    def holds(a: int, b: int, c: int, x: float, y: float, i: int) -> bool:
        if c < 0:
            return turn(a, b, i) > 0
        if b < 0:
            return turn(c, a, i) > 0
        if a < 0:
            return turn(b, c, i) > 0
        ax, ay, bx, by, cx, cy = xs[a] - x, ys[a] - y, xs[b] - x, ys[b] - y, xs[c] - x, ys[c] - y
        aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return ax * (by * cc - bb * cy) - ay * (bx * cc - bb * cx) + aa * (bx * cy - by * cx) > 0

    a, b, c = order[:3]
    if turn(a, b, c) < 0:
        a, b = b, a
    put(a, b, c)
    for u, v in ((b, a), (c, b), (a, c)):
        put(u, v, _GHOST)
    for i in order[3:]:
        x, y = xs[i], ys[i]
        while c >= 0:
            if turn(a, b, i) < 0:
                a, b = b, a
            elif turn(b, c, i) < 0:
                a, b = c, b
            elif turn(c, a, i) < 0:
                a, b = a, c
            else:
                break
            c = apex[a, b]
        hole, rim = [(a, b), (b, c), (c, a)], []
        for e in hole:
            del apex[e]
        while hole:
            u, v = hole.pop()
            w = apex.get((v, u))
            if w is not None and holds(v, u, w, x, y, i):
                del apex[v, u], apex[u, w], apex[w, v]
                hole += [(u, w), (w, v)]
            elif w is not None:
                rim.append((u, v))
        for u, v in rim:
            put(u, v, i)
        a, b = next(e for e in rim if e[0] >= 0 and e[1] >= 0)
        c = i
    return np.array([(a, b, c) for (a, b), c in apex.items() if 0 <= a < b and a < c], int).reshape(-1, 3)


def _circles(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of the circles through triangles' corners, the same for any order of
    the corners."""
    t = np.sort(t, 1)
    a = p[t[:, 0]]
    u, v = p[t[:, 1]] - a, p[t[:, 2]] - a
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.stack([(v[:, 1] * uu - u[:, 1] * vv) / d, (u[:, 0] * vv - v[:, 0] * uu) / d], 1)
    return a + c, np.sqrt((c * c).sum(1))


def _corner_columns() -> list[str]:
    return [f"{c}{i}" for i in range(3) for c in _POINT]


def _schema(points: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = dict(points.dtypes)
    return ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} double" for c in _corner_columns())])


def _faces(table, keys: tuple[str, ...], at: np.ndarray, t: np.ndarray):
    """Triangles as an Arrow table of keys and corners."""
    import pyarrow as pa

    cols = {k: table.column(k).combine_chunks().take(pa.array(np.zeros(len(t), np.int64))) for k in keys}
    for i in range(3):
        for j, c in enumerate(_POINT):
            cols[f"{c}{i}"] = pa.array(at[t[:, i], j])
    return pa.table(cols)


def _array(table, names) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in names], 1) if table.num_rows else np.zeros((0, len(names)))


def triangulated(points: DataFrame, keys: tuple[str, ...] = KEYS, strip: int = STRIP) -> DataFrame:
    """(keys, x0 ... w2): the Delaunay faces of points (keys, x, y, z on the sphere, u, w in the
    plane) of each network.  Rows that repeat a place count once; networks of fewer than three
    points have no faces."""
    points = shared.settled(points.select(*keys, *(F.col(c).cast("double").alias(c) for c in _POINT)).dropDuplicates([*keys, "u", "w"]))
    marks = F.percentile_approx("u", [i / STRIPS for i in range(1, STRIPS)], 10_000)
    nets = points.groupBy(*keys).agg(F.count("*").alias("_n"), marks.alias("_q"))
    parts = F.least(F.lit(STRIPS), F.ceil(F.col("_n") / strip)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda j: F.element_at("_q", F.floor(j * STRIPS / F.col("_parts")).cast("int")))
    nets = nets.withColumn("_parts", parts).select(*keys, F.when(F.col("_parts") > 1, F.array_distinct(cuts)).otherwise(F.array().cast("array<double>")).alias("_cuts"))
    dealt = points.join(nets, list(keys)).withColumn("_own", F.size(F.filter("_cuts", lambda c: c <= F.col("u"))))
    last = F.size("_cuts")
    group = lambda at: F.floor(at / OWN).cast("int")
    dealt = dealt.withColumn("_strip", F.explode(F.sequence(group(F.greatest(F.col("_own") - 1, F.lit(0))), group(F.least(F.col("_own") + 1, last)))))
    bound = lambda at, none: F.when((at >= 1) & (at <= last), F.element_at("_cuts", F.greatest(F.least(at, last), F.lit(1)).cast("int"))).otherwise(F.lit(none))
    s, inf = F.col("_strip") * OWN, float("inf")
    dealt = dealt.select(*keys, *_POINT, "_strip", bound(s, -inf).alias("_lo"), bound(s + OWN, inf).alias("_hi"), bound(s - 1, -inf).alias("_from"), bound(s + OWN + 1, inf).alias("_to"), (last >= OWN).alias("_many"))

    def one(table):
        at = _array(table, _POINT)
        lo, hi, known_from, known_to = (table.column(c)[0].as_py() for c in ("_lo", "_hi", "_from", "_to"))
        t = delaunay(at[:, 3:])
        if table.column("_many")[0].as_py():
            # corners in order of place: every strip reckons the same circle
            rank = np.empty(len(at), int)
            rank[np.lexsort((at[:, 4], at[:, 3]))] = np.arange(len(at))
            p = np.empty((len(at), 2))
            p[rank] = _moved(at[:, 3:])
            centre, reach = _circles(p, rank[t])
            x = centre[:, 0]
            t = t[(x >= lo) & (x < hi) & (x - reach > known_from) & (x + reach < known_to)]
            mine = (at[:, 3] >= lo) & (at[:, 3] < hi)
            return _marked(table, keys, at, t, mine)
        return _marked(table, keys, at, t, None)

    schema = _schema(points, keys)
    first = shared.settled(dealt.groupBy(*keys, "_strip").applyInArrow(one, f"{schema}, _alone boolean, _sides int, _foreign int"))
    return _whole(first.where("not _alone").drop("_alone", "_sides", "_foreign").unionByName(_open(first, keys, schema)))


def _marked(table, keys: tuple[str, ...], at: np.ndarray, t: np.ndarray, mine: np.ndarray | None):
    """Triangles of a strip with what the second pass needs of them: bits of the sides that no
    other triangle of the strip has (``_sides``) and of the corners that are not the strip's
    own (``_foreign``).  The strip's own points (``mine``) that are no corners are rows of one
    point, ``_alone``.  A network of one strip (``mine`` is none) has nothing open."""
    import pyarrow as pa

    sides = foreign = np.zeros(len(t), np.int32)
    alone = np.zeros(0, int)
    if mine is not None:
        alone = np.setdiff1d(np.flatnonzero(mine), t)
    if mine is not None and len(t):
        ends = np.sort(np.stack([t, np.roll(t, -1, 1)], 2), 2).astype(np.int64)
        _, at_, n = np.unique(ends[:, :, 0] * len(at) + ends[:, :, 1], return_inverse=True, return_counts=True)
        bits = np.array([1, 2, 4])
        sides = ((n[at_].reshape(-1, 3) == 1) @ bits).astype(np.int32)
        foreign = (~mine[t] @ bits).astype(np.int32)
    zero = np.zeros(len(alone), np.int32)
    rows = np.concatenate([t, np.repeat(alone[:, None], 3, 1)]).astype(int)
    return _faces(table, keys, at, rows).append_column("_alone", pa.array(np.repeat([False, True], [len(t), len(alone)]))).append_column("_sides", pa.array(np.concatenate([sides, zero]), pa.int32())).append_column("_foreign", pa.array(np.concatenate([foreign, zero]), pa.int32()))


def _whole(faces: DataFrame) -> DataFrame:
    """Without what is thinner than THIN: points on a line, moved off it."""
    side = lambda i, j: F.hypot(F.col(f"u{i}") - F.col(f"u{j}"), F.col(f"w{i}") - F.col(f"w{j}"))
    twice = (F.col("u1") - F.col("u0")) * (F.col("w2") - F.col("w0")) - (F.col("w1") - F.col("w0")) * (F.col("u2") - F.col("u0"))
    return faces.where(F.abs(twice) > THIN * F.greatest(side(0, 1), side(1, 2), side(2, 0)))


def _open(first: DataFrame, keys: tuple[str, ...], schema: str) -> DataFrame:
    """The faces that no strip could be sure of.  Only sides that are single in their strip, and
    corners in another's, are shuffled: what is inside of a strip is settled there."""
    corner = lambda i: F.struct(*(F.col(f"{c}{i}").alias(c) for c in _POINT))
    has = lambda c, i: F.col(c).bitwiseAND(1 << i) != 0
    of = lambda c, each: F.explode(F.filter(F.array(*(F.when(has(c, i), each(i)) for i in range(3))), lambda x: x.isNotNull()))
    sides = first.where("_sides > 0").select(*keys, of("_sides", lambda i: F.struct(corner(i).alias("a"), corner((i + 1) % 3).alias("b"))).alias("e"))
    ends = [F.col("e.a"), F.col("e.b")]
    edges = sides.groupBy(*keys, F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).agg(F.count("*").alias("n"), F.first(F.col("e.a") < F.col("e.b")).alias("ahead"))
    edges = shared.settled(edges.where("n = 1").select(*keys, F.when(F.col("ahead"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("ahead"), F.col("b")).otherwise(F.col("a")).alias("b")))
    used = first.where("_foreign > 0").select(*keys, of("_foreign", corner).alias("p")).select(*keys, "p.u", "p.w").distinct()
    alone = first.where("_alone").select(*keys, *(F.col(f"{c}0").alias(c) for c in _POINT)).join(used, [*keys, "u", "w"], "left_anti").select(*keys, *_POINT)
    rim = edges.select(*keys, F.explode(F.array("a", "b")).alias("p")).select(*keys, *(F.col(f"p.{c}").alias(c) for c in _POINT))
    left = shared.settled(rim.unionByName(alone).distinct())
    ways = edges.select(*keys, *(F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "ab" for c in "uw"))

    def rest(mine, other):
        at = _array(mine, _POINT)
        t = delaunay(at[:, 3:])
        number = {(u, w): i for i, (u, w) in enumerate(at[:, 3:].tolist())}
        done = {(number[a, b], number[c, d]) for a, b, c, d in _array(other, ("au", "aw", "bu", "bw")).tolist()}
        return _faces(mine, keys, at, t[_behind(t, done)])

    return left.groupBy(*keys).cogroup(ways.groupBy(*keys)).applyInArrow(rest, schema)


def _behind(t: np.ndarray, done: set[tuple[int, int]]) -> np.ndarray:
    """Which triangles are on the open side of the directed edges of final faces: those that
    have such an edge backwards, and their neighbours, as far as the next such edge.  Without
    edges, all."""
    if not done:
        return np.ones(len(t), bool)
    of = {}
    for k, (a, b, c) in enumerate(t.tolist()):
        of[a, b] = of[b, c] = of[c, a] = k
    todo = [of[b, a] for a, b in done if (b, a) in of]
    keep = np.zeros(len(t), bool)
    keep[todo] = True
    while todo:
        a, b, c = t[todo.pop()].tolist()
        for e in ((a, b), (b, c), (c, a)):
            k = of.get(e[::-1])
            if k is not None and e[::-1] not in done and e not in done and not keep[k]:
                keep[k] = True
                todo.append(k)
    return keep


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row: an explode of one row keeps the optimiser
    from writing their formulas into everything that uses them."""
    for name, c in columns.items():
        df = df.withColumn(name, F.explode(F.array(c)))
    return df


# --- planes -------------------------------------------------------------------------------------


def _axes(centre: Column) -> tuple[Column, Column]:
    """East and north at a centre; any pair at a pole."""
    pole = F.abs(centre["z"]) > 1 - 1e-12
    east = S.normalise(F.when(pole, S.vector(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(S.vector(-centre["y"], centre["x"], F.lit(0.0))))
    return east, S.cross(centre, east)


def in_plane(v: Column, centre: Column) -> Column:
    """(u, w): equal-area plane coordinates about a centre."""
    def flat(p, c):
        east, north = _axes(c)
        k = F.sqrt(2 / F.greatest(1 + S.dot(p, c), F.lit(1e-12)))
        return F.struct((k * S.dot(p, east)).alias("u"), (k * S.dot(p, north)).alias("w"))

    return S.let(flat, v, centre)


def straight(v: Column, centre: Column) -> Column:
    """(u, w): a plane in which great circles are straight; null a quarter turn or more off."""
    def flat(p, c):
        east, north = _axes(c)
        k = S.dot(p, c)
        return F.when(k > 1e-9, F.struct((S.dot(p, east) / k).alias("u"), (S.dot(p, north) / k).alias("w")))

    return S.let(flat, v, centre)


# --- cells that follow size ---------------------------------------------------------------------


def level(size: Column) -> Column:
    """The level of cells for things of a size: two to the level is at least the size, and
    levels are even, so sizes within four of each other share one."""
    return (2 * F.ceil(F.log2(F.greatest(size, F.lit(1e-12))) / 2)).cast("int")


def cells(low: list[Column], high: list[Column], at: Column) -> Column:
    """The cells of level ``at`` that a box touches: two in each direction at most, where the
    box is no larger than a cell."""
    edge = F.pow(F.lit(2.0), at)
    place = lambda c: F.floor(c / edge).cast("long")
    span = [F.sequence(place(a), place(b)) for a, b in zip(low, high, strict=True)]
    def longer(have: Column, more: Column) -> Column:
        return F.flatten(F.transform(have, lambda h: F.transform(more, lambda j: F.concat(h, F.array(j)))))

    return functools.reduce(longer, span[1:], F.transform(span[0], lambda i: F.array(i)))


def cell(place: list[Column], at: Column) -> Column:
    """The cell of level ``at`` of a point."""
    edge = F.pow(F.lit(2.0), at)
    return F.array(*(F.floor(c / edge).cast("long") for c in place))


def levels(df: DataFrame, name: str = "_level") -> list[int]:
    """The levels in use: a few dozen at most, whatever the rows."""
    return sorted(r[0] for r in df.select(name).distinct().collect())


# --- forced edges -------------------------------------------------------------------------------


def corner(i: int) -> Column:
    """A corner of a face as (x, y, z, u, w)."""
    return F.struct(*(F.col(f"{c}{i}").alias(c) for c in _POINT))


#: Pieces that an edge is cut to at most, to find the circles it meets; pieces broadcast at most.
PIECES, FEW_PIECES = 4096, 500_000


def _about(faces: DataFrame, edges: DataFrame, nets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(_face) of the faces whose circles an edge (keys, a, b) meets, and some more: points on
    the edge change no others.  Edges are cut to pieces as long as the circles' cells; faces so
    flat that their circles are unsure are all taken."""
    f = once(faces.select(*keys, "_face", *(corner(i).alias(f"_{i}") for i in range(3))), _c=_circle(F.col("_0"), F.col("_1"), F.col("_2")))
    side = lambda i, j: F.hypot(F.col(f"_{i}.u") - F.col(f"_{j}.u"), F.col(f"_{i}.w") - F.col(f"_{j}.w"))
    height = F.abs(_twice(F.col("_0"), F.col("_1"), F.col("_2"))) / F.greatest(side(0, 1), side(1, 2), side(2, 0))
    r = F.hypot(F.col("_c.u") - F.col("_0.u"), F.col("_c.w") - F.col("_0.w"))
    f = f.select(*keys, "_face", F.col("_c.u").alias("_u"), F.col("_c.w").alias("_w"), (r * 1.001 + 1e-9).alias("_r"), height.alias("_height"))
    flat = F.col("_r").isNull() | (F.col("_height") < 1e-7)
    e = edges.join(nets.select(*keys, "centre"), list(keys)).withColumn("_long", S.angle(F.col("a"), F.col("b")))
    longest = e.agg(F.max("_long")).first()[0] or 0.0
    round_ = f.where(~flat).withColumn("_level", level(F.greatest(2 * F.col("_r"), F.lit(longest / PIECES))))
    used = levels(round_)
    e = e.withColumn("_level", F.explode(F.array(*map(F.lit, used or [0])))).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_long") / F.pow(F.lit(2.0), F.col("_level")))).cast("int"))
    e = e.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    v = [S.vector(*(F.col(f"{c}.{k}") for k in "xyz")) for c in "ab"]
    at = lambda i: in_plane(S.normalise(S.arc_point(*v, i / F.col("_n"))), F.col("centre"))
    e = once(e, _p=at(F.col("_i")), _q=at(F.col("_i") + 1))
    # a piece swells out from its chord
    e = e.withColumn("_pad", F.pow(F.col("_long") / F.col("_n"), 2) / 2 + 1e-9)
    low, high = ([of(f"_p.{c}", f"_q.{c}") + s * F.col("_pad") for c in "uw"] for of, s in ((F.least, -1), (F.greatest, 1)))
    pieces = shared.settled(e.select(*keys, "_level", F.explode(cells(low, high, F.col("_level"))).alias("_cell"), "_p", "_q", "_pad"))
    low, high = ([F.col(f"_{c}") + s * F.col("_r") for c in "uw"] for s in (-1, 1))
    round_ = round_.withColumn("_cell", F.explode(cells(low, high, F.col("_level"))))
    met = round_.join(F.broadcast(pieces) if pieces.count() <= FEW_PIECES else pieces, [*keys, "_level", "_cell"])
    du, dw, pu, pw = F.col("_q.u") - F.col("_p.u"), F.col("_q.w") - F.col("_p.w"), F.col("_u") - F.col("_p.u"), F.col("_w") - F.col("_p.w")
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(du * pu + dw * pw, du * du + dw * dw), F.lit(0.0))))
    met = met.where(F.hypot(pu - part * du, pw - part * dw) <= F.col("_r") + F.col("_pad"))
    return met.select("_face").unionByName(f.where(flat).select("_face")).distinct()


def _flat(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """(u, w) as :func:`in_plane`, of one point."""
    east = np.array([1.0, 0.0, 0.0]) if abs(centre[2]) > 1 - 1e-12 else np.array([-centre[1], centre[0], 0.0])
    east = east / np.linalg.norm(east)
    k = math.sqrt(2 / max(1 + float(v @ centre), 1e-12))
    return np.array([k * float(v @ east), k * float(v @ np.cross(centre, east))])


def _thick(at: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Triangles that are not thinner than THIN."""
    p = at[:, 3:][t]
    u, v = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    side = np.maximum(np.hypot(*u.T), np.maximum(np.hypot(*v.T), np.hypot(*(v - u).T)))
    return t[np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) > THIN * side]


def _forced(faces: np.ndarray, want: np.ndarray, hull: np.ndarray, alone: np.ndarray, centre: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Points, triangles and whether edges are missing: the faces (n, 3, 5) of a part of a network
    made again with the edges ``want`` (n, 2, 5), of which those that are missing are halved.
    The part ends at its own border, but is open where the border is the ``hull`` (n, 2, 2)."""
    number: dict[tuple[float, float], int] = {}
    at: list[np.ndarray] = []

    def of(p: np.ndarray) -> int:
        i = number.setdefault((float(p[3]) + 0.0, float(p[4]) + 0.0), len(at))
        if i == len(at):
            at.append(p)
        return i

    have = [[of(p) for p in f] for f in faces]
    edges = {tuple(sorted((of(a), of(b)))) for a, b in want}
    for p in alone:
        of(p)
    ways = {(f[i], f[(i + 1) % 3]) for f in have for i in range(3)}
    ends = [[number.get((float(u) + 0.0, float(w) + 0.0)) for u, w in e] for e in hull]
    rim = {frozenset(e) for e in ends if None not in e}
    done = {(b, a) for a, b in ways if (b, a) not in ways and frozenset((a, b)) not in rim}
    for _ in range(rounds):
        points = np.array(at)
        t = delaunay(points[:, 3:])
        t = _thick(points, t[_behind(t, done)]) if len(t) else t
        sides = {tuple(sorted((f[i], f[(i + 1) % 3]))) for f in t.tolist() for i in range(3)}
        miss = [e for e in edges if e not in sides]
        if not miss:
            return points, t, False
        for a, b in miss:
            m = at[a][:3] + at[b][:3]
            m = m / np.linalg.norm(m)
            i = of(np.concatenate([m, _flat(m, centre)]))
            edges.remove((a, b))
            edges |= {tuple(sorted(e)) for e in ((a, i), (i, b)) if e[0] != e[1]}
    return points, t, True


def conforming(points: DataFrame, edges: DataFrame, nets: DataFrame, keys: tuple[str, ...] = KEYS, *, rounds: int = 25, strip: int = STRIP) -> DataFrame:
    """The faces of :func:`triangulated`, with every one of ``edges`` (keys, a, b: points) a row
    of edges of faces: an edge that is none gets its middle as a new point, until all are.
    ``nets``: (keys, centre).

    A network is triangulated once: new points are on the edges, so only faces whose circles
    an edge meets (and the hull's, beyond which an edge may swell) can change.  These few, a
    network's along its edges, are one task, and are made again until all edges are there."""
    import pyarrow as pa

    on = list(keys)
    edges = shared.settled(edges.select(*keys, "a", "b"))
    faces = shared.settled(triangulated(points, keys, strip).withColumn("_face", F.monotonically_increasing_id()))
    asked = F.broadcast(edges.select(*keys).distinct())
    mine = faces.join(asked, on, "left_semi")
    ends = [F.struct(F.col(f"u{i}").alias("u"), F.col(f"w{i}").alias("w")) for i in range(3)]
    sides = mine.select(*keys, "_face", F.explode(F.array(*(F.struct(F.least(ends[i], ends[(i + 1) % 3]).alias("a"), F.greatest(ends[i], ends[(i + 1) % 3]).alias("b")) for i in range(3)))).alias("e"))
    hull = shared.settled(sides.groupBy(*keys, "e").agg(F.count("*").alias("n"), F.min("_face").alias("_face")).where("n = 1").select(*keys, "_face", "e.a", "e.b"))
    near = shared.settled(_about(mine, edges, nets, keys).unionByName(hull.select("_face")).distinct())
    far = faces.join(near, "_face", "left_anti").drop("_face")
    used = mine.select(*keys, F.explode(F.array(*ends)).alias("p")).select(*keys, "p.u", "p.w").distinct()
    alone = points.select(*keys, *_POINT).join(asked, on, "left_semi").join(used, [*on, "u", "w"], "left_anti").select(*keys, F.struct(*_POINT).alias("a"))
    none = F.lit(0.0)
    full = lambda c: F.struct(*(none.alias(k) for k in "xyz"), F.col(f"{c}.u").alias("u"), F.col(f"{c}.w").alias("w"))
    rows = edges.withColumn("_kind", F.lit(0)).unionByName(hull.select(*keys, full("a").alias("a"), full("b").alias("b"), F.lit(1).alias("_kind"))).unionByName(alone.select(*keys, "a", F.col("a").alias("b"), F.lit(2).alias("_kind")))
    names = [[f"{s}{c}" for c in _POINT] for s in "ab"]
    rows = rows.join(F.broadcast(nets.select(*keys, "centre")), on).select(*keys, "_kind", *(F.col(f"{s}.{c}").cast("double").alias(f"{s}{c}") for s in "ab" for c in _POINT), *(F.col(f"centre.{c}").alias(f"c{c}") for c in "xyz"))

    def again(left, right):
        corners = _array(left, _corner_columns()).reshape(-1, 3, 5)
        pairs, kind = np.stack([_array(right, n) for n in names], 1), right.column("_kind").to_numpy()
        centre = _array(right.slice(0, 1), ["cx", "cy", "cz"])[0]
        at, t, missing = _forced(corners, pairs[kind == 0], pairs[kind == 1][:, :, 3:], pairs[kind == 2][:, 0], centre, rounds)
        made = _faces(right, keys, at, t)
        if missing and not len(t):
            made = _faces(right, keys, at, np.zeros((1, 3), int))
        return made.append_column("_missing", pa.array([missing] * made.num_rows, pa.bool_()))

    kept = faces.join(near, "_face", "left_semi").drop("_face")
    made = shared.settled(kept.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(again, _schema(points, keys) + ", _missing boolean"))
    if not made.where("_missing").isEmpty():
        raise ValueError(f"edges that are not part of the network after {rounds} rounds")
    return far.unionByName(made.drop("_missing"))


# --- outlines -----------------------------------------------------------------------------------


#: Edges of all outlines of one network that its points carry at most.
FEW_EDGES = 64


def held_by_few(points: DataFrame, edges: DataFrame, keys: tuple[str, ...] = KEYS, *, name: str = "name") -> DataFrame:
    """Points (keys, u, w and other columns) with ``_names``: the outlines that hold them, as
    :func:`held`, where a network's outlines have so few edges that each point tests them all."""
    lists = edges.groupBy(*keys).agg(F.collect_list(F.struct(F.col(name).alias("n"), "u0", "w0", "u1", "w1")).alias("_edges"))
    over = lambda e: (e["w0"] > F.col("w")) != (e["w1"] > F.col("w"))
    right = lambda e: e["u0"] + (F.col("w") - e["w0"]) * (e["u1"] - e["u0"]) / (e["w1"] - e["w0"]) > F.col("u")
    crossed = F.transform(F.filter("_edges", lambda e: F.when(over(e), right(e)).otherwise(False)), lambda e: e["n"])
    odd = lambda all_: F.filter(F.array_distinct(all_), lambda n: F.size(F.filter(all_, lambda m: m == n)) % 2 == 1)
    rows = points.join(F.broadcast(lists), list(keys)).withColumn("_crossed", crossed)
    return rows.withColumn("_names", odd(F.col("_crossed"))).drop("_edges", "_crossed")


def held(points: DataFrame, edges: DataFrame, keys: tuple[str, ...] = KEYS, *, point: str = "id", name: str = "name") -> DataFrame:
    """(keys, point, name) of points (keys, point, u, w) in outlines (keys, name, u0, w0, u1, w1:
    edges).  Edges are joined with points by bands as high as the edge, so an outline of any
    length is many small rows; a point is inside where an odd number of edges is to its right."""
    high = F.abs(F.col("w1") - F.col("w0"))
    bands = edges.withColumn("_level", level(F.greatest(high, F.lit(1e-6))))
    lines = bands.withColumn("_cell", F.explode(cells([F.least("w0", "w1")], [F.greatest("w0", "w1")], F.col("_level"))))
    used = levels(bands)
    if not used:
        return points.select(*keys, point).withColumn(name, F.lit(None).cast(dict(edges.dtypes)[name])).where("false")
    rows = points.select(*keys, point, "u", "w", F.explode(F.array(*map(F.lit, used))).alias("_level"))
    rows = rows.withColumn("_cell", cell([F.col("w")], F.col("_level")))
    over = (F.col("w0") > F.col("w")) != (F.col("w1") > F.col("w"))
    right = F.col("u0") + (F.col("w") - F.col("w0")) * (F.col("u1") - F.col("u0")) / (F.col("w1") - F.col("w0")) > F.col("u")
    crossed = rows.join(lines, [*keys, "_level", "_cell"]).where(over).where(right)
    return crossed.groupBy(*keys, point, name).agg(F.count("*").alias("_n")).where("_n % 2 = 1").drop("_n")


# --- natural neighbours -------------------------------------------------------------------------


def _circle(a: Column, b: Column, c: Column) -> Column:
    """(u, w) of the centre of the circle through three points of a plane."""
    def centre(a, b, c):
        bu, bw, cu, cw = b["u"] - a["u"], b["w"] - a["w"], c["u"] - a["u"], c["w"] - a["w"]
        d = 2 * (bu * cw - bw * cu)
        bb, cc = bu * bu + bw * bw, cu * cu + cw * cw
        return F.struct((a["u"] + F.try_divide(cw * bb - bw * cc, d)).alias("u"), (a["w"] + F.try_divide(bu * cc - cu * bb, d)).alias("w"))

    return S.let(centre, a, b, c)


def _twice(a: Column, b: Column, c: Column) -> Column:
    return (b["u"] - a["u"]) * (c["w"] - a["w"]) - (b["w"] - a["w"]) * (c["u"] - a["u"])


def natural_rows(points: DataFrame, faces: DataFrame, key: str = "id") -> DataFrame:
    """(key, v, topology_id, vertex, w): natural-neighbour weights of points (key, v,
    topology_id) inside the Delaunay faces (topology_id, vertices, centre) of their network.

    A vertex's weight is the part of its Voronoi cell that the point's cell would take.  It is
    a sum over the faces whose circles hold the point, of the signed areas between the
    circle's middle and those of the circles through the point and two corners; so points meet
    faces by cells of the circles' size, and weights are one sum by point and vertex.  Points
    of one place are weighed once.  Points are moved by 1e-9 of a radian, since on a line
    through two vertices circles are endless."""
    named, points = points.select(key, "v", "topology_id"), points.select("v", "topology_id").distinct().withColumn(key, F.xxhash64("v"))
    flat = lambda i: in_plane(F.element_at("vertices", i), F.col("centre"))
    f = once(faces.select("topology_id", "vertices", "centre"), _t=F.struct(*(flat(i).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c")))))
    f = once(f, _c=_circle(F.col("_t.a"), F.col("_t.b"), F.col("_t.c")))
    f = once(f, _r=F.hypot(F.col("_c.u") - F.col("_t.a.u"), F.col("_c.w") - F.col("_t.a.w"))).where("_r is not null").withColumn("_level", level(2 * F.col("_r"))).drop("centre")
    nets = faces.groupBy("topology_id").agg(F.first("centre").alias("centre"))
    p = points.select(key, "v", "topology_id").join(nets, "topology_id").withColumn("_p", in_plane(F.col("v"), F.col("centre")))
    p = once(p, _p=F.struct((F.col("_p.u") + 1e-9).alias("u"), (F.col("_p.w") + 7e-10).alias("w"))).select(key, "v", "topology_id", "_p")
    p = shared.settled(p)
    # a network's faces that are away from all of its points hold none
    reach = p.groupBy("topology_id").agg(*(of(f"_p.{c}").alias(f"_{n}{c}") for n, of in (("least", F.min), ("most", F.max)) for c in "uw"))
    low, high = ([F.col(f"_c.{c}") + s * F.col("_r") for c in "uw"] for s in (-1, 1))
    meets = [(a <= F.col(f"_most{c}")) & (b >= F.col(f"_least{c}")) for a, b, c in zip(low, high, "uw", strict=True)]
    f = shared.settled(f.join(reach, "topology_id").where(meets[0] & meets[1]).drop(*(f"_{n}{c}" for n in ("least", "most") for c in "uw")))
    used = levels(f)
    index = f.withColumn("_cell", F.explode(cells(low, high, F.col("_level"))))
    p = p.withColumn("_level", F.explode(F.array(*map(F.lit, used or [0])))).withColumn("_cell", cell([F.col("_p.u"), F.col("_p.w")], F.col("_level")))
    met = p.join(index, ["topology_id", "_level", "_cell"]).where(F.hypot(F.col("_p.u") - F.col("_c.u"), F.col("_p.w") - F.col("_c.w")) < F.col("_r"))
    q, a, b, c, o = (F.col(n) for n in ("_p", "_t.a", "_t.b", "_t.c", "_c"))
    met = once(met, _o=F.struct(_circle(q, b, c).alias("_1"), _circle(a, q, c).alias("_2"), _circle(a, b, q).alias("_3")))
    shares = [_twice(F.col(f"_o._{i}"), F.col(f"_o._{j}"), o) for i, j in ((2, 3), (3, 1), (1, 2))]
    turned = F.when(_twice(a, b, c) < 0, -1).otherwise(1)
    each = F.array(*(F.struct(F.element_at("vertices", i + 1).alias("vertex"), (turned * s).alias("w")) for i, s in enumerate(shares)))
    rows = met.select(key, "v", "topology_id", F.explode(each).alias("e")).groupBy(key, "v", "topology_id", "e.vertex").agg(F.sum("e.w").alias("w"))
    total = rows.groupBy(key, "topology_id").agg(F.sum("w").alias("_all"))
    weights = rows.join(total, [key, "topology_id"]).where("_all <> 0").select("v", "topology_id", "vertex", (F.col("w") / F.col("_all")).alias("w"))
    return named.join(weights, ["v", "topology_id"]).select(key, "v", "topology_id", "vertex", "w")
