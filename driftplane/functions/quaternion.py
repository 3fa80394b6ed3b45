"""Finite rotations as unit quaternions: struct<w, x, y, z> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sphere import EPSILON, bound, clamp, cross, dot, from_lat_lon, lat, let, lon, norm, normalise, scale, vector


def make(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def identity() -> Column:
    return make(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))


@bound
def conjugate(q: Column) -> Column:
    return make(q["w"], -q["x"], -q["y"], -q["z"])


@bound
def negate(q: Column) -> Column:
    return make(-q["w"], -q["x"], -q["y"], -q["z"])


@bound
def inner(a: Column, b: Column) -> Column:
    return a["w"] * b["w"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


@bound
def multiply(a: Column, b: Column) -> Column:
    """First b, then a."""
    return make(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


@bound
def from_axis(axis: Column, angle: Column) -> Column:
    """Rotation by ``angle`` radians about a unit axis."""
    s = F.sin(angle / 2)
    return make(F.cos(angle / 2), axis["x"] * s, axis["y"] * s, axis["z"] * s)


def from_pole(pole_lat: Column, pole_lon: Column, degrees: Column) -> Column:
    return from_axis(from_lat_lon(pole_lat, pole_lon), F.radians(degrees))


@bound
def is_identity(q: Column) -> Column:
    return F.abs(q["w"]) >= 1 - EPSILON


@bound
def angle(q: Column) -> Column:
    """Radians, in [0, 2 pi]; about :func:`axis`.  Exact for small angles as well."""
    return 2 * F.atan2(F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"]), q["w"])


@bound
def axis(q: Column) -> Column:
    """Unit axis; null for the identity, which has none."""
    return F.when(~is_identity(q), normalise(vector(q["x"], q["y"], q["z"])))


@bound
def to_pole(q: Column, hint: Column | None = None) -> Column:
    """struct(lat, lon, angle) in degrees; null for the identity.  With a hint axis, axis and
    angle are both negated where the axis points away from it."""

    def pole(a: Column, turn: Column) -> Column:
        return F.struct(lat(a).alias("lat"), lon(a).alias("lon"), turn.alias("angle"))

    def towards(a: Column, turn: Column) -> Column:
        away = dot(a, hint) < 0
        return let(pole, F.when(away, scale(a, F.lit(-1.0))).otherwise(a), F.when(away, -turn).otherwise(turn))

    return F.when(~is_identity(q), let(pole if hint is None else towards, axis(q), F.degrees(angle(q))))


@bound
def shortest(q: Column) -> Column:
    """The same rotation by at most half a turn."""
    return F.when(q["w"] < 0, negate(q)).otherwise(q)


@bound
def slerp(a: Column, b: Column, t: Column) -> Column:
    """From a (t = 0) to b (t = 1) the short way; a where they are one rotation."""

    def mixed(u: Column, v: Column) -> Column:
        return make(u * a["w"] + v * b["w"], u * a["x"] + v * b["x"], u * a["y"] + v * b["y"], u * a["z"] + v * b["z"])

    def turned(d: Column, theta: Column) -> Column:
        s = F.sin(theta)
        return F.when(F.abs(d) >= 1 - EPSILON, a).otherwise(let(mixed, F.sin((1 - t) * theta) / s, F.when(d < 0, -1.0).otherwise(1.0) * F.sin(t * theta) / s))

    return let(lambda d: let(turned, d, F.acos(clamp(F.abs(d)))), inner(a, b))


@bound
def slerp3(a: Column, b: Column, c: Column, wa: Column, wb: Column, wc: Column) -> Column:
    """Nested interpolation by weights that sum to one."""
    first = slerp(a, b, F.when(wa + wb > EPSILON, wb / (wa + wb)).otherwise(F.lit(0.0)))
    return F.when(wa + wb <= EPSILON, c).otherwise(slerp(first, c, wc))


@bound
def rotate(q: Column, v: Column) -> Column:
    """The rotated vector."""
    w, x, y, z = q["w"], q["x"], q["y"], q["z"]
    tx, ty, tz = y * v["z"] - z * v["y"], z * v["x"] - x * v["z"], x * v["y"] - y * v["x"]
    d, k = x * v["x"] + y * v["y"] + z * v["z"], 2 * w * w - 1
    return vector(k * v["x"] + 2 * (w * tx + d * x), k * v["y"] + 2 * (w * ty + d * y), k * v["z"] + 2 * (w * tz + d * z))


@bound
def rotate_line(q: Column, line: Column) -> Column:
    return F.transform(line, lambda p: rotate(q, p))


@bound
def rotate_rings(q: Column, rings: Column) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: rotate(q, p)))


@bound
def between(a: Column, b: Column) -> Column:
    """The great-circle rotation that takes point a to point b; identity where they agree
    (and, with no axis defined, where they are opposite)."""

    def about(n: Column, size: Column) -> Column:
        return F.when(size < EPSILON, identity()).otherwise(from_axis(scale(n, 1 / size), F.atan2(size, dot(a, b))))

    return let(lambda n: let(about, n, norm(n)), cross(a, b))


@bound
def around(pole: Column, a: Column, b: Column) -> Column:
    """The small-circle rotation about ``pole`` from a's meridian to b's."""

    def turn(fa: Column, fb: Column) -> Column:
        return F.when((norm(fa) < EPSILON) | (norm(fb) < EPSILON), identity()).otherwise(from_axis(pole, F.atan2(dot(pole, cross(fa, fb)), dot(fa, fb))))

    return let(turn, cross(pole, a), cross(pole, b))


@bound
def segment_to_segment(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Takes the start of one segment to the start of another, then turns about it until the
    ends are in line."""
    return let(lambda first: multiply(around(b0, rotate(first, a1), b1), first), between(a0, b0))
