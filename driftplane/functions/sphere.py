"""Points on the unit sphere as columns: struct<x, y, z>, or latitude and longitude in degrees.

All functions build Catalyst expressions; nothing here runs Python on executors.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres.
EQUATORIAL_RADIUS, POLAR_RADIUS, MEAN_RADIUS = 6378.137, 6356.7523142, 6371.009
EPSILON = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _simple(c: Column) -> bool:
    """A reference or a short expression: cheap to repeat."""
    return len(c._jc.toString() if hasattr(c, "_jc") else str(c)) <= 48


def let(f: Callable[..., Column], *args) -> Column:
    """f(*args) with every longer argument computed once.

    Column functions use their arguments many times over; nested, the expression would grow
    with the power of the depth.  A lambda over a one-element array binds the values."""
    long = [i for i, a in enumerate(args) if isinstance(a, Column) and not _simple(a)]
    if not long:
        return f(*args)
    held = F.array(F.struct(*(args[i].alias(f"a{i}") for i in long)))
    return F.get(F.transform(held, lambda s: f(*(s[f"a{i}"] if i in long else a for i, a in enumerate(args)))), F.lit(0))


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """Makes a column function compute its longer arguments once."""
    return functools.wraps(f)(lambda *args, **kw: let(functools.partial(f, **kw) if kw else f, *args))


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def from_lat_lon(lat: Column | str, lon: Column | str) -> Column:
    p, m = F.radians(col(lat).cast("double")), F.radians(col(lon).cast("double"))
    return vector(F.cos(p) * F.cos(m), F.cos(p) * F.sin(m), F.sin(p))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


@bound
def lat(v: Column) -> Column:
    return F.degrees(F.asin(clamp(v["z"])))


@bound
def lon(v: Column) -> Column:
    return F.degrees(F.atan2(v["y"], v["x"]))


@bound
def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


@bound
def cross(a: Column, b: Column) -> Column:
    return vector(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


@bound
def scale(a: Column, k: Column) -> Column:
    return vector(a["x"] * k, a["y"] * k, a["z"] * k)


@bound
def add(a: Column, b: Column) -> Column:
    return vector(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


@bound
def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


@bound
def normalise(a: Column) -> Column:
    return scale(a, 1 / norm(a))


@bound
def angle(a: Column, b: Column) -> Column:
    """Angular distance in radians."""
    return F.acos(clamp(dot(a, b)))


def distance_km(a: Column, b: Column, radius: float = EQUATORIAL_RADIUS) -> Column:
    return angle(a, b) * radius


@bound
def point_to_arc(p: Column, a: Column, b: Column) -> Column:
    """Least angular distance from a point to the great-circle arc a-b (shorter than pi).

    Inside the arc's lune the distance is to its plane, else to the nearer end."""

    def with_normal(n: Column) -> Column:
        # p is between the ends if it is on their side of the two planes across the arc
        inside = (dot(cross(n, a), p) >= 0) & (dot(cross(b, n), p) >= 0) & (norm(n) > EPSILON)
        return F.when(inside, F.asin(clamp(F.abs(dot(n, p)) / norm(n)))).otherwise(F.least(angle(p, a), angle(p, b)))

    return let(with_normal, cross(a, b))


@bound
def closest_on_arc(p: Column, a: Column, b: Column, first: Column | None = None) -> Column:
    """The arc's point nearest to ``p``; of equally near ends the first.  ``first``: whether the
    first end is the nearer one, where that is known better than from the cosines."""

    def with_normal(n: Column) -> Column:
        inside = (dot(cross(n, a), p) >= 0) & (dot(cross(b, n), p) >= 0) & (norm(n) > EPSILON)
        flat = add(p, scale(n, -dot(n, p) / dot(n, n)))
        # by the cosines, which tell apart what acos makes equal
        return F.when(inside, normalise(flat)).when(dot(p, a) >= dot(p, b) if first is None else first, a).otherwise(b)

    return let(with_normal, cross(a, b))


@bound
def arcs_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two arcs cross inside both."""

    def test(m: Column, n: Column) -> Column:
        side = lambda v, w: F.signum(dot(v, w))
        opposite = (side(m, c) * side(m, d) < 0) & (side(n, a) * side(n, b) < 0)
        return opposite & (side(m, c) == side(n, b))

    return let(test, cross(a, b), cross(c, d))


@bound
def arc_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The point where two crossing arcs meet; null if they do not cross."""
    pick = lambda at: F.when(dot(at, add(a, b)) >= 0, at).otherwise(scale(at, F.lit(-1.0)))
    return F.when(arcs_cross(a, b, c, d), let(pick, normalise(cross(cross(a, b), cross(c, d)))))


@bound
def arc_point(a: Column, b: Column, t: Column) -> Column:
    """The point at the fraction ``t`` of the arc a-b."""

    def at(w: Column) -> Column:
        mix = add(scale(a, F.sin((1 - t) * w) / F.sin(w)), scale(b, F.sin(t * w) / F.sin(w)))
        return F.when(F.sin(w) < EPSILON, a).otherwise(mix)

    return let(at, angle(a, b))


@bound
def tessellate(a: Column, b: Column, step: float) -> Column:
    """Points of the arc a-b at most ``step`` radians apart, ends included."""
    return let(lambda n: F.transform(F.sequence(F.lit(0), n), lambda i: arc_point(a, b, i / n)), F.greatest(F.lit(1), F.ceil(angle(a, b) / step)).cast("int"))


@bound
def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """Signed area of a spherical triangle in steradians; positive if anticlockwise."""
    return 2 * F.atan2(dot(a, cross(b, c)), 1 + dot(a, b) + dot(b, c) + dot(c, a))


def _edges(ring: Column) -> Column:
    """(a, b) of each edge of a ring of points, closed."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    return F.zip_with(ring, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


@bound
def centroid(ring: Column) -> Column:
    """Normalised sum of the points; the first point where the sum vanishes."""
    zero = vector(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    total = F.aggregate(ring, zero, lambda acc, p: vector(acc["x"] + p["x"], acc["y"] + p["y"], acc["z"] + p["z"]))
    return let(lambda t: F.when(norm(t) < EPSILON, F.element_at(ring, 1)).otherwise(normalise(t)), total)


@bound
def ring_area(ring: Column) -> Column:
    """Signed area of a ring: the triangles of its edges and its centroid; of three points, their
    triangle alone."""
    fan = let(lambda middle: F.aggregate(_edges(ring), F.lit(0.0), lambda acc, e: acc + triangle_area(middle, e["a"], e["b"])), centroid(ring))
    return F.when(F.size(ring) == 3, triangle_area(*(F.get(ring, F.lit(i)) for i in range(3)))).otherwise(fan)


@bound
def polygon_area(rings: Column) -> Column:
    """Area of an exterior ring less the areas of its holes."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return F.abs(ring_area(F.element_at(rings, 1))) - F.aggregate(holes, F.lit(0.0), lambda acc, r: acc + F.abs(ring_area(r)))


@bound
def oriented(ring: Column, clockwise: bool) -> Column:
    wrong = ring_area(ring) > 0 if clockwise else ring_area(ring) < 0
    return F.when(wrong, F.reverse(ring)).otherwise(ring)


def length(line: Column) -> Column:
    """Sum of the arcs of a polyline, in radians."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    steps = F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: angle(a, b))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


@bound
def outline_centroid(line: Column) -> Column:
    """Centroid of a polyline, each arc weighted by its length."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    parts = F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: scale(normalise(add(a, b)), angle(a, b)))
    total = F.aggregate(parts, vector(F.lit(0.0), F.lit(0.0), F.lit(0.0)), lambda acc, p: vector(acc["x"] + p["x"], acc["y"] + p["y"], acc["z"] + p["z"]))
    return let(lambda t: F.when(norm(t) < EPSILON, F.element_at(line, 1)).otherwise(normalise(t)), total)


#: Turns the point that is outside away from the symmetries of round coordinates.
_ASIDE = (0.00123, -0.00371, 0.00289)


@bound
def point_in_ring(p: Column, ring: Column) -> Column:
    """Whether a point is inside a ring, its boundary included.

    Counts the edges that the arc from a point beside the antipode of the ring's centroid
    (outside) to the point crosses; an odd number is inside.  A vertex on the arc's plane
    counts as on its positive side, so passing through it counts once."""

    def within(out: Column) -> Column:
        def crosses(m: Column, e: Column, n: Column) -> Column:
            c, d, o, q = dot(m, e["a"]) >= 0, dot(m, e["b"]) >= 0, dot(n, out) >= 0, dot(n, p) >= 0
            return (c != d) & (o != q) & (c == q)

        def count(m: Column) -> Column:
            return F.aggregate(_edges(ring), F.lit(0), lambda acc, e: acc + let(lambda n: F.when(crosses(m, e, n), 1).otherwise(0), cross(e["a"], e["b"])))

        return let(count, cross(out, p)) % 2 == 1

    near = F.exists(_edges(ring), lambda e: point_to_arc(p, e["a"], e["b"]) < 1e-9)
    aside = vector(*(F.lit(x) for x in _ASIDE))
    return near | let(within, normalise(add(scale(centroid(ring), F.lit(-1.0)), aside)))


@bound
def in_triangle(p: Column, ring: Column) -> Column:
    """Whether a point is on no outer side of the three edges of a triangle, to the last bit."""
    sides = F.transform(_edges(ring), lambda e: dot(cross(e["a"], e["b"]), p))
    return F.forall(sides, lambda s: s >= 0) | F.forall(sides, lambda s: s <= 0)


def point_in_polygon(p: Column, rings: Column) -> Column:
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return point_in_ring(p, F.element_at(rings, 1)) & ~F.exists(holes, lambda h: point_in_ring(p, h))


@bound
def bounding_circle(ring: Column) -> Column:
    """struct(centre, cos_radius): the least circle about the centroid that holds a ring's
    points.  Its edges are within the circle too if the radius is under a quarter turn."""
    return let(lambda c: F.struct(c.alias("centre"), F.array_min(F.transform(ring, lambda p: dot(c, p))).alias("cos_radius")), centroid(ring))


@bound
def in_circle(v: Column, circle: Column) -> Column:
    """Whether a point is in a bounding circle, its edge included."""
    return dot(v, circle["centre"]) >= circle["cos_radius"] - EPSILON


@bound
def circles_meet(a: Column, b: Column) -> Column:
    """Whether two bounding circles have a point in common."""
    return angle(a["centre"], b["centre"]) <= F.acos(clamp(a["cos_radius"])) + F.acos(clamp(b["cos_radius"])) + EPSILON


@bound
def widened(circle: Column, by: Column) -> Column:
    """A bounding circle with its radius changed by an angle: at least nothing, at most the
    whole sphere.  A negative angle contracts it."""
    return F.struct(circle["centre"].alias("centre"), F.cos(F.greatest(F.lit(0.0), F.least(F.lit(3.141592653589793), F.acos(clamp(circle["cos_radius"])) + by))).alias("cos_radius"))


@bound
def destination(v: Column, azimuth: Column, distance: Column) -> Column:
    """The point at an angular distance (radians) and azimuth (radians from north)."""
    p, m = F.asin(clamp(v["z"])), F.atan2(v["y"], v["x"])
    north = vector(-F.sin(p) * F.cos(m), -F.sin(p) * F.sin(m), F.cos(p))
    east = vector(-F.sin(m), F.cos(m), F.lit(0.0))
    d = add(scale(north, F.cos(azimuth)), scale(east, F.sin(azimuth)))
    return add(scale(v, F.cos(distance)), scale(d, F.sin(distance)))


@bound
def small_circle(centre: Column, radius: Column, n: int) -> Column:
    """n points of a small circle (radius in radians), as :func:`destination` gives them; what all
    points share is computed once."""
    turns = [2 * math.pi * i / n for i in range(n)]
    steps = F.array(*(F.struct(F.lit(math.cos(t)).alias("c"), F.lit(math.sin(t)).alias("s")) for t in turns))
    p, m = F.asin(clamp(centre["z"])), F.atan2(centre["y"], centre["x"])
    north = vector(-F.sin(p) * F.cos(m), -F.sin(p) * F.sin(m), F.cos(p))
    east = vector(-F.sin(m), F.cos(m), F.lit(0.0))
    point = lambda a, u, w, t: vector(*(a[c] + u[c] * t["c"] + w[c] * t["s"] for c in "xyz"))
    return let(lambda a, u, w: F.transform(steps, lambda t: point(a, u, w, t)), scale(centre, F.cos(radius)), scale(north, F.sin(radius)), scale(east, F.sin(radius)))


@bound
def ellipse(centre: Column, major: Column, minor: Column, azimuth: Column, n: int) -> Column:
    """n points of an ellipse on the sphere; semi-axes in radians, major along the azimuth."""

    def point(i: Column) -> Column:
        a = 2 * 3.141592653589793 * i / n
        x, y = major * F.cos(a), minor * F.sin(a)
        return destination(centre, azimuth + F.atan2(y, x), F.sqrt(x * x + y * y))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


@bound
def small_circle_great_circle(centre: Column, radius: Column, pole: Column) -> Column:
    """Where the circle of points at ``radius`` from ``centre`` meets the plane of ``pole``:
    an array of no, one or two points."""

    def meet(d: Column) -> Column:
        # null where the circle's centre is a pole of the plane: they are parallel
        base = scale(add(centre, scale(pole, -d)), F.cos(radius) / F.nullif(1 - d * d, F.lit(0.0)))

        def from_base(base: Column, left: Column, along: Column) -> Column:
            step = F.sqrt(F.greatest(left, F.lit(0.0))) / F.nullif(norm(along), F.lit(0.0))
            two = F.array(add(base, scale(along, step)), add(base, scale(along, -step)))
            none = F.slice(two, F.lit(1), F.lit(0))
            return F.when((1 - d * d < EPSILON) | (left < -EPSILON), none).when(F.abs(left) <= EPSILON, F.slice(two, F.lit(1), F.lit(1))).otherwise(two)

        return let(lambda base: let(from_base, base, 1 - dot(base, base), cross(centre, pole)), base)

    return let(meet, dot(centre, pole))


def wrap_longitude(c: Column, centre: float = 0.0) -> Column:
    """Longitude brought into [centre - 180, centre + 180)."""
    return F.pmod(c - F.lit(centre - 180.0), F.lit(360.0)) + F.lit(centre - 180.0)


def cell(v: Column, size: float) -> Column:
    """Cube of edge ``size`` that holds a point, as struct<i, j, k>."""
    f = lambda c: F.floor(c / size).cast("int")
    return F.struct(f(v["x"]).alias("i"), f(v["y"]).alias("j"), f(v["z"]).alias("k"))
