"""Map projections and local frames as columns (radians in, unit-sphere lengths out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sphere import EPSILON, bound, clamp, let


def equal_area(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Azimuthal equal-area: struct(u, v) of a point in degrees about a centre in degrees."""
    p, q, d = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    k = F.sqrt(2 / (1 + F.sin(q) * F.sin(p) + F.cos(q) * F.cos(p) * F.cos(d)))
    return F.struct((k * F.cos(p) * F.sin(d)).alias("u"), (k * (F.cos(q) * F.sin(p) - F.sin(q) * F.cos(p) * F.cos(d))).alias("v"))


@bound
def _inverse(u: Column, v: Column, c: Column, rho: Column, lat0: Column, lon0: Column) -> Column:
    q = F.radians(lat0)
    lat = F.asin(clamp(F.cos(c) * F.sin(q) + v * F.sin(c) * F.cos(q) / rho))
    polar = F.when(q > 0, F.atan2(u, -v)).otherwise(F.atan2(u, v))
    usual = F.atan2(u * F.sin(c), rho * F.cos(q) * F.cos(c) - v * F.sin(q) * F.sin(c))
    turn = F.when(F.abs(F.abs(lat0) - 90) < 1e-9, polar).otherwise(usual)
    at_centre = rho < EPSILON
    lon = F.pmod(lon0 + F.degrees(turn) + 180, F.lit(360.0)) - 180
    return F.struct(F.when(at_centre, lat0).otherwise(F.degrees(lat)).alias("lat"), F.when(at_centre, lon0).otherwise(lon).alias("lon"))


def equal_area_inverse(u: Column, v: Column, lat0: Column, lon0: Column) -> Column:
    return let(lambda rho: _inverse(u, v, 2 * F.asin(clamp(rho / 2)), rho, lat0, lon0), F.sqrt(u * u + v * v))


def gnomonic(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """struct(u, v); null where the point is a quarter turn or more from the centre."""
    p, q, d = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    c = F.sin(q) * F.sin(p) + F.cos(q) * F.cos(p) * F.cos(d)
    return F.when(c > EPSILON, F.struct((F.cos(p) * F.sin(d) / c).alias("u"), ((F.cos(q) * F.sin(p) - F.sin(q) * F.cos(p) * F.cos(d)) / c).alias("v")))


def gnomonic_inverse(u: Column, v: Column, lat0: Column, lon0: Column) -> Column:
    return let(lambda rho: _inverse(u, v, F.atan(rho), rho, lat0, lon0), F.sqrt(u * u + v * v))


@bound
def to_north_east_down(v: Column, lat: Column, lon: Column) -> Column:
    """Components of a Cartesian vector in the local frame at a point (degrees)."""
    p, m = F.radians(lat), F.radians(lon)
    north = -F.sin(p) * F.cos(m) * v["x"] - F.sin(p) * F.sin(m) * v["y"] + F.cos(p) * v["z"]
    east = -F.sin(m) * v["x"] + F.cos(m) * v["y"]
    down = -(F.cos(p) * F.cos(m) * v["x"] + F.cos(p) * F.sin(m) * v["y"] + F.sin(p) * v["z"])
    return F.struct(north.alias("n"), east.alias("e"), down.alias("d"))


@bound
def from_north_east_down(v: Column, lat: Column, lon: Column) -> Column:
    p, m = F.radians(lat), F.radians(lon)
    x = -F.sin(p) * F.cos(m) * v["n"] - F.sin(m) * v["e"] - F.cos(p) * F.cos(m) * v["d"]
    y = -F.sin(p) * F.sin(m) * v["n"] + F.cos(m) * v["e"] - F.cos(p) * F.sin(m) * v["d"]
    return F.struct(x.alias("x"), y.alias("y"), (F.cos(p) * v["n"] - F.sin(p) * v["d"]).alias("z"))
