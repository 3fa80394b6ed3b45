"""Velocities, net rotation, strain rates and accumulated strain, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import projections as P
from ..functions import quaternion as Q
from ..functions import sphere as S
from . import rotation_model as R
from . import shared

#: Kilometres per million years to centimetres a year; area of the sphere as
#: published tables state it, over the sum of cos(latitude) of a whole-degree grid.
KM_MY_TO_CM_YR = 0.1
GRID_AREA = 510_000_000 / 41_252


def interval(time: Column, delta: Column, kind: str, clamp: bool = True) -> Column:
    """struct(older, younger) about a time: ``t_plus`` (t + d, t), ``t_minus`` (t, t - d) or
    ``centred``; an interval that would reach the future becomes (d, 0)."""
    older, younger = {"t_plus": (time + delta, time), "t_minus": (time, time - delta), "centred": (time + delta / 2, time - delta / 2)}[kind]
    early = (younger < 0) if clamp else F.lit(False)
    return F.struct(F.when(early, delta).otherwise(older).alias("older"), F.when(early, 0.0).otherwise(younger).alias("younger"))


def stage_quaternion(older: Column, younger: Column) -> Column:
    """From the older to the younger total rotation, the short way."""
    return Q.shortest(Q.multiply(younger, Q.conjugate(older)))


def speed(stage: Column, delta: Column) -> Column:
    """Speed in cm/yr a quarter turn from the axis of a stage rotation over ``delta`` My."""
    return Q.angle(stage) / delta * S.EQUATORIAL_RADIUS * KM_MY_TO_CM_YR


@S.bound
def velocity(v: Column, stage: Column, delta: Column) -> Column:
    """Cartesian velocity in cm/yr of a point under a stage rotation over ``delta`` My."""
    k = speed(stage, delta)
    zero = S.vector(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return F.when(Q.is_identity(stage), zero).otherwise(S.scale(S.cross(Q.axis(stage), v), k))


@S.bound
def colatitude_longitude(vel: Column, lat: Column, lon: Column) -> Column:
    """struct(colat, lon): southward and eastward components at a point in degrees."""
    return S.let(lambda ned: F.struct((-ned["n"]).alias("colat"), ned["e"].alias("lon")), P.to_north_east_down(vel, lat, lon))


@S.bound
def magnitude_azimuth(vel: Column, lat: Column, lon: Column) -> Column:
    """struct(magnitude, angle, azimuth): angle anticlockwise from east in radians; azimuth
    clockwise from north in [0, 2 pi)."""
    found = lambda n, e: F.struct(
        F.sqrt(n * n + e * e).alias("magnitude"), F.atan2(n, e).alias("angle"), F.pmod(F.atan2(e, n), F.lit(2 * 3.141592653589793)).alias("azimuth")
    )
    return S.let(lambda ned: found(ned["n"], ned["e"]), P.to_north_east_down(vel, lat, lon))


def point_velocities(points: DataFrame, model: DataFrame, delta: float, kind: str = "t_plus") -> DataFrame:
    """Rows (plate_id, time, v) with ``velocity``: rotations come by two broadcast lookups."""
    d = F.lit(float(delta))
    df = points.withColumn("_i", interval(F.col("time").cast("double"), d, kind)).withColumn("_a", F.col("_i.older")).withColumn("_b", F.col("_i.younger"))
    df = R.lookup(R.lookup(df, model, time="_a", out="_q1"), model, time="_b", out="_q2")
    df = df.withColumn("_s", stage_quaternion(F.col("_q1"), F.col("_q2")))
    return df.withColumn("velocity", velocity(F.col("v"), F.col("_s"), d)).drop("_i", "_a", "_b", "_q1", "_q2", "_s")


def kinematic_series(points: DataFrame, model: DataFrame, times: list[float], delta: float = 1.0, kind: str = "t_plus") -> DataFrame:
    """Latitude, longitude, speed, azimuth and components of points through time."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in times]))
    rows = R.lookup(shared.spread(points).withColumn("time", t), model, out="_q").withColumn("v", Q.rotate(F.col("_q"), F.col("v"))).drop("_q")
    rows = point_velocities(rows, model, delta, kind).withColumn("lat", S.lat(F.col("v"))).withColumn("lon", S.lon(F.col("v")))
    out = rows.withColumn("_m", magnitude_azimuth(F.col("velocity"), F.col("lat"), F.col("lon"))).withColumn("_c", colatitude_longitude(F.col("velocity"), F.col("lat"), F.col("lon")))
    return out.withColumns({"speed": F.col("_m.magnitude"), "azimuth": F.degrees("_m.azimuth"), "vel_colat": F.col("_c.colat"), "vel_lon": F.col("_c.lon")}).drop("_m", "_c")


@S.bound
def smoothed(inside: Column, average: Column, distance: Column, reach: float) -> Column:
    """Velocity near a boundary: f v + (1 - f) average, with f = distance / reach."""
    f = F.least(F.lit(1.0), distance / reach)
    return S.add(S.scale(inside, f), S.scale(average, 1 - f))


@S.bound
def net_rotation_terms(v: Column, stage: Column, delta: Column) -> Column:
    """struct(x, y, z, weight, area) of one grid point: omega cos(lat), (x^2 + y^2) cos(lat)
    and cos(lat); rotation in degrees per My; all zero without motion."""
    still = Q.is_identity(stage) | (delta == 0)
    zero = lambda x: F.when(still, 0.0).otherwise(x)

    def terms(omega: Column, c: Column) -> Column:
        return F.struct(zero(omega["x"] * c).alias("x"), zero(omega["y"] * c).alias("y"), zero(omega["z"] * c).alias("z"), zero((v["x"] ** 2 + v["y"] ** 2) * c).alias("weight"), zero(c).alias("area"))

    s = S.scale(Q.axis(stage), F.degrees(Q.angle(stage)) / delta)
    return S.let(terms, S.cross(v, S.cross(s, v)), F.sqrt(F.greatest(1 - v["z"] * v["z"], F.lit(0.0))))


def net_rotation_by_plate(points: DataFrame, stages: DataFrame, delta: float) -> DataFrame:
    """Component sums by plate, for points (plate_id, v) and stages (plate_id, q)."""
    df = points.join(F.broadcast(stages.select("plate_id", "q")), "plate_id").withColumn("_t", net_rotation_terms(F.col("v"), F.col("q"), F.lit(float(delta))))
    return df.groupBy("plate_id").agg(*(F.sum(f"_t.{c}").alias(c) for c in ("x", "y", "z", "weight", "area")), F.count("*").alias("points")).withColumn("area_km2", F.col("area") * GRID_AREA)


def net_rotation_total(by_plate: DataFrame) -> DataFrame:
    """(lat, lon, rate): the pole and degrees per My of the whole lithosphere."""
    t = by_plate.where("weight <> 0").agg(*(F.sum(c).alias(c) for c in ("x", "y", "z", "weight")))
    v = S.vector(F.col("x") / F.col("weight"), F.col("y") / F.col("weight"), F.col("z") / F.col("weight"))
    t = t.withColumn("_v", v).withColumn("rate", S.norm(F.col("_v"))).withColumn("_u", S.normalise(F.col("_v")))
    return t.select(S.lat(F.col("_u")).alias("lat"), S.lon(F.col("_u")).alias("lon"), "rate")


def whole_degree_grid(spark) -> DataFrame:
    """(lat, lon, v): latitudes -90 to 90 and longitudes -180 to 180, both ends included."""
    g = spark.range(181 * 361).select((F.floor(F.col("id") / 361) - 90).cast("double").alias("lat"), (F.col("id") % 361 - 180).cast("double").alias("lon"))
    return g.withColumn("v", S.from_lat_lon("lat", "lon"))


# --- strain: tensors are struct<tt, tp, pt, pp> (theta southward, phi eastward) -------------


def tensor(tt: Column, tp: Column, pt: Column, pp: Column) -> Column:
    return F.struct(tt.alias("tt"), tp.alias("tp"), pt.alias("pt"), pp.alias("pp"))


def face_gradient(points: list[tuple[Column, Column]], velocities: list[tuple[Column, Column]], radius_m: float = S.EQUATORIAL_RADIUS * 1000) -> Column:
    """Velocity gradient (1/s) on a spherical triangle.

    ``points``: (colatitude, longitude) in radians of three vertices; ``velocities``: their
    (theta, phi) components in m/s.  A linear fit, with the metric terms at the centroid;
    zero for degenerate triangles and at the poles."""
    (t0, p0), (t1, p1), (t2, p2) = points
    det = (t1 - t0) * (p2 - p0) - (t2 - t0) * (p1 - p0)
    theta = (t0 + t1 + t2) / 3

    def slopes(k: int) -> tuple[Column, Column, Column]:
        u0, u1, u2 = (v[k] for v in velocities)
        return ((u1 - u0) * (p2 - p0) - (u2 - u0) * (p1 - p0)) / det, ((u2 - u0) * (t1 - t0) - (u1 - u0) * (t2 - t0)) / det, (u0 + u1 + u2) / 3

    tt, tp, ut = slopes(0)
    pt, pp, up = slopes(1)
    sin, cos = F.sin(theta), F.cos(theta)
    bad = (F.abs(det) < S.EPSILON) | (F.abs(sin) < S.EPSILON)
    safe = lambda x: F.when(bad, 0.0).otherwise(x)
    return tensor(safe(tt / radius_m), safe((tp - up * cos) / (radius_m * sin)), safe(pt / radius_m), safe((pp + ut * cos) / (radius_m * sin)))


@S.bound
def dilatation_rate(g: Column) -> Column:
    return g["tt"] + g["pp"]


@S.bound
def second_invariant(g: Column) -> Column:
    shear = 0.5 * (g["tp"] + g["pt"])
    return F.sqrt(g["tt"] ** 2 + g["pp"] ** 2 + 2 * shear**2)


@S.bound
def clamped(g: Column, most: float) -> Column:
    """The gradient scaled so that its second invariant is at most ``most``."""
    k = S.let(lambda i: F.when(i > most, F.lit(most) / i).otherwise(F.lit(1.0)), second_invariant(g))
    return S.let(lambda k: tensor(g["tt"] * k, g["tp"] * k, g["pt"] * k, g["pp"] * k), k)


def _principal(a: Column, b: Column, d: Column) -> tuple[Column, Column]:
    """Eigenvalues of a symmetric matrix (a b; b d), larger first."""
    mid, off = (a + d) / 2, F.sqrt(((a - d) / 2) ** 2 + b**2)
    return mid + off, mid - off


@S.bound
def style(g: Column) -> Column:
    """-2 (contraction) to 2 (extension), 0 for shear; null without strain."""
    p1, p2 = _principal(g["tt"], 0.5 * (g["tp"] + g["pt"]), g["pp"])
    return S.let(lambda p, q: F.when(F.greatest(F.abs(p), F.abs(q)) > 0, (p + q) / F.greatest(F.abs(p), F.abs(q))), p1, p2)


def unit_tensor() -> Column:
    return tensor(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


@S.bound
def product(a: Column, b: Column) -> Column:
    return tensor(a["tt"] * b["tt"] + a["tp"] * b["pt"], a["tt"] * b["tp"] + a["tp"] * b["pp"], a["pt"] * b["tt"] + a["pp"] * b["pt"], a["pt"] * b["tp"] + a["pp"] * b["pp"])


@S.bound
def determinant(a: Column) -> Column:
    return a["tt"] * a["pp"] - a["tp"] * a["pt"]


@S.bound
def advanced(f: Column, before: Column, after: Column, dt: Column) -> Column:
    """The deformation gradient after a step: inverse(I - L1 dt / 2) (I + L0 dt / 2) F;
    unchanged where that inverse does not exist."""
    h = dt / 2
    m = tensor(1 - after["tt"] * h, -after["tp"] * h, -after["pt"] * h, 1 - after["pp"] * h)
    n = tensor(1 + before["tt"] * h, before["tp"] * h, before["pt"] * h, 1 + before["pp"] * h)
    solve = lambda m, d: F.when(F.abs(d) < S.EPSILON, f).otherwise(product(product(tensor(m["pp"] / d, -m["tp"] / d, -m["pt"] / d, m["tt"] / d), n), f))
    return S.let(lambda m: S.let(solve, m, determinant(m)), m)


def accumulated(rates: Column) -> Column:
    """Deformation gradient after an ordered array of struct(dt, g): a fold over the steps."""
    zero = tensor(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    start = F.struct(unit_tensor().alias("f"), F.coalesce(F.get(rates, 0)["g"], zero).alias("g"))
    end = F.aggregate(rates, start, lambda acc, r: F.struct(advanced(acc["f"], acc["g"], r["g"], r["dt"]).alias("f"), tensor(r["g"]["tt"], r["g"]["tp"], r["g"]["pt"], r["g"]["pp"]).alias("g")))
    return end["f"]


def accumulate_by(df: DataFrame, key: str, time: str, gradient: str) -> DataFrame:
    """(key, f): strain of each key over its time-ordered gradients (older first)."""
    steps = F.sort_array(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col(gradient).alias("g"))), asc=False)
    rows = df.groupBy(key).agg(steps.alias("s"))
    with_dt = F.transform("s", lambda x, i: F.struct(F.when(i == 0, 0.0).otherwise(F.get("s", i - 1)["t"] - x["t"]).alias("dt"), x["g"].alias("g")))
    return rows.withColumn("r", with_dt).select(key, accumulated(F.col("r")).alias("f"))


@S.bound
def strain_dilatation(f: Column) -> Column:
    return F.abs(determinant(f)) - 1


@S.bound
def principal_strain(f: Column) -> Column:
    """struct(major, minor, angle): stretches less one, from the inverse of the left
    Cauchy-Green tensor; zero where it has none."""

    def of(a: Column, b: Column, d: Column) -> Column:
        det = a * d - b * b
        safe = lambda x: F.when(det <= 0, 0.0).otherwise(x)
        e1, e2 = _principal(d / det, -b / det, a / det)
        return F.struct(safe(1 / F.sqrt(e2) - 1).alias("major"), safe(1 / F.sqrt(e1) - 1).alias("minor"), safe(0.5 * F.atan2(2 * b, a - d)).alias("angle"))

    return S.let(of, f["tt"] ** 2 + f["tp"] ** 2, f["tt"] * f["pt"] + f["tp"] * f["pp"], f["pt"] ** 2 + f["pp"] ** 2)


@S.bound
def interpolated(a: Column, b: Column, part: Column) -> Column:
    mix = lambda c: a[c] + (b[c] - a[c]) * part
    return tensor(mix("tt"), mix("tp"), mix("pt"), mix("pp"))


def time_slot(time: Column, begin: float, increment: float, slots: int) -> Column:
    """struct(slot, fraction, nearest): position (begin - t) / increment, snapped to a slot
    within 1e-9; null outside; the nearest slot is the earlier below one half."""
    pos = (F.lit(begin) - time) / increment
    snap = F.abs(pos - F.round(pos)) < 1e-9
    slot = F.when(snap, F.round(pos)).otherwise(F.floor(pos)).cast("int")
    part = F.when(snap, 0.0).otherwise(pos - F.floor(pos))
    inside = (pos >= -1e-9) & (pos <= slots - 1 + 1e-9)
    return F.when(inside, F.struct(slot.alias("slot"), part.alias("fraction"), (slot + F.when(part < 0.5, 0).otherwise(1)).alias("nearest")))


DEFAULT_THICKNESS_KM = 40.0


def crustal_thinning(thickness: Column, initial: Column) -> Column:
    """struct(stretching, thinning): beta = Ti / T, gamma = 1 - T / Ti."""
    return F.struct((initial / thickness).alias("stretching"), (1 - thickness / initial).alias("thinning"))


def evolved_thickness(rates: Column, initial: Column) -> Column:
    """Thickness after an ordered array of struct(dt, rate): each step shrinks it by its
    dilatation, (1 - r dt / 2) / (1 + r dt / 2)."""
    return F.aggregate(rates, initial, lambda t, s: t * (1 - s["rate"] * s["dt"] / 2) / (1 + s["rate"] * s["dt"] / 2))


def surface_velocities(points: DataFrame, polygons: DataFrame, model: DataFrame, delta: float, kind: str = "t_plus", *, key: str = "id", **options) -> DataFrame:
    """Velocities of domain points (id, time, v) by the surface that holds them, with why:
    ``in_network``, ``in_boundary``, ``in_polygon`` or ``none`` (no velocity)."""
    from . import partition

    hit = partition.first_hit(points, polygons.withColumn("plate_id", F.struct("plate_id", F.coalesce("kind", F.lit("static_polygon")).alias("kind"))), key=key, **options)
    rows = hit.withColumn("plate_id", F.col("hit.plate_id")).withColumn("reason", F.when(F.col("hit").isNull(), "none").when(F.col("hit.kind").isin("network", "rigid_block"), "in_network").when(F.col("hit.kind") == "boundary", "in_boundary").otherwise("in_polygon"))
    out = point_velocities(rows.drop("hit"), model, delta, kind)
    return out.withColumn("velocity", F.when(F.col("reason") != "none", F.col("velocity")))


#: Whose motion velocities show: the surfaces that hold the points, or the points' own plates.
SOLVE = ("surfaces", "domain_points")


def solved_velocities(points: DataFrame, model: DataFrame, delta: float, mode: str = "surfaces", *, polygons: DataFrame | None = None, kind: str = "t_plus", **options) -> DataFrame:
    """Velocities of domain points (id, time, v) by the surfaces that hold them, or of points
    (id, time, v, plate_id) by their own plates."""
    if mode not in SOLVE or (mode == "surfaces") != (polygons is not None):
        raise ValueError(f"the mode is one of {SOLVE}; surfaces need polygons, domain points none")
    return surface_velocities(points, polygons, model, delta, kind, **options) if mode == "surfaces" else point_velocities(points, model, delta, kind)
