"""More registered queries: geometry, partitioning, co-registration of geometries, kinematics,
rasters and topologies, each with SQL that works the result out from plain formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import _OCT_ID, ORACLES, C, P, T, XYZ, _shown, customers, gradients, latlon, mul, conj, named, octants, parts, q_out, quat, query, r6, rnd, rot_sql, samples, suppliers, table, turn, xyz_out
from .functions import projections
from .functions import quaternion as Q
from .functions import sphere as S
from .operators import coregistration, evolution, generate, geometry, kinematics, partition, predicates, proximity, raster, reconstruct, topology
from .operators import rotation_model as R

Vec = tuple[str, str, str]
A, B, D = ("ax", "ay", "az"), ("hx", "hy", "hz"), ("dx", "dy", "dz")


def dt(a: Vec, b: Vec) -> str:
    return "(" + " + ".join(f"({p}) * ({q})" for p, q in zip(a, b, strict=True)) + ")"


def cr(a: Vec, b: Vec) -> Vec:
    return tuple(f"(({a[i]}) * ({b[j]}) - ({a[j]}) * ({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1)))  # type: ignore[return-value]


def norm(a: Vec) -> str:
    return f"sqrt({dt(a, a)})"


def ang(a: Vec, b: Vec) -> str:
    return f"acos(greatest(-1e0, least(1e0, {dt(a, b)})))"


def vec(prefix: str) -> Vec:
    return tuple(f"{prefix}{c}" for c in "xyz")  # type: ignore[return-value]


def xyz(lat: str, lon: str, prefix: str) -> str:
    return f"cos(radians({lat})) * cos(radians({lon})) AS {prefix}x, cos(radians({lat})) * sin(radians({lon})) AS {prefix}y, sin(radians({lat})) AS {prefix}z"


def to_arc(p: Vec, a: Vec, b: Vec) -> str:
    """Distance of a point to an arc, in SQL."""
    n = cr(a, b)
    return f"CASE WHEN {dt(cr(n, a), p)} >= 0 AND {dt(cr(b, n), p)} >= 0 AND {norm(n)} > 1e-12 THEN asin(least(1e0, abs({dt(n, p)}) / {norm(n)})) ELSE least({ang(p, a)}, {ang(p, b)}) END"


def area(a: Vec, b: Vec, c: Vec) -> str:
    return f"(2 * atan2({dt(a, cr(b, c))}, 1 + {dt(a, b)} + {dt(b, c)} + {dt(c, a)}))"


#: Three points a customer: a, b (in SQL h: "by" is a word of SQL) and d.
G = f"k AS (SELECT c_custkey AS id, CAST((c_custkey * 53) % 179 - 89 AS DOUBLE) AS la, CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) AS oa, CAST((c_custkey * 17) % 171 - 85 AS DOUBLE) AS lb, CAST((c_custkey * 59) % 360 - 180 AS DOUBLE) AS ob, CAST((c_custkey * 23) % 167 - 83 AS DOUBLE) AS ld, CAST((c_custkey * 83) % 360 - 180 AS DOUBLE) AS od FROM customer), g AS (SELECT *, {xyz('la', 'oa', 'a')}, {xyz('lb', 'ob', 'h')}, {xyz('ld', 'od', 'd')} FROM k)"


def triples(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    deg = lambda m, n, o: (k * m % n - o).cast("double")
    t = table(spark, d, "customer").select(k.alias("id"), deg(53, 179, 89).alias("la"), deg(37, 360, 180).alias("oa"), deg(17, 171, 85).alias("lb"), deg(59, 360, 180).alias("ob"), deg(23, 167, 83).alias("ld"), deg(83, 360, 180).alias("od"))
    return t.withColumns({"a": S.from_lat_lon("la", "oa"), "b": S.from_lat_lon("lb", "ob"), "d": S.from_lat_lon("ld", "od")})


def _first_of_tie(*degrees) -> Column:
    """Whether the first of two points is at most as far from a third as the second, in C's
    arithmetic (latitudes and longitudes in degrees; null where they are)."""

    def first(*at):
        import math

        if None in at:
            return None
        v = [(math.cos(p) * math.cos(m), math.cos(p) * math.sin(m), math.sin(p)) for p, m in zip(*[map(math.radians, at)] * 2, strict=True)]
        far = [math.acos(max(-1.0, min(1.0, v[2][0] * e[0] + v[2][1] * e[1] + v[2][2] * e[2]))) for e in v[:2]]
        return far[0] <= far[1]

    return F.udf(first, "boolean", useArrow=True)(*degrees)


def out(v: Vec) -> str:
    return ", ".join(f"{rnd(e)} AS {c}" for e, c in zip(v, "xyz", strict=True))


# --- sphere -----------------------------------------------------------------------------------


@query("point_to_arc_distance", f"WITH {G} SELECT id, {rnd(to_arc(D, A, B))} AS angle FROM g")
def _(spark, d):
    return triples(spark, d).select("id", r6(S.point_to_arc(F.col("d"), F.col("a"), F.col("b"))).alias("angle"))


_N = f"n AS (SELECT *, {', '.join(f'{e} AS n{c}' for e, c in zip(cr(A, B), 'xyz', strict=True))} FROM g)"
_FLAT: Vec = tuple(f"({p} - {n} * {dt(vec('n'), D)} / {dt(vec('n'), vec('n'))})" for p, n in zip(D, vec("n"), strict=True))  # type: ignore[assignment]
_IN = f"{dt(cr(vec('n'), A), D)} >= 0 AND {dt(cr(B, vec('n')), D)} >= 0 AND {norm(vec('n'))} > 1e-12"


@query("closest_point_on_arc", f"WITH {G}, {_N}, f AS (SELECT *, {_IN} AS inside, {', '.join(f'{e} AS f{c}' for e, c in zip(_FLAT, 'xyz', strict=True))} FROM n) SELECT id, {', '.join(rnd(f'CASE WHEN inside THEN f{c} / {norm(vec(chr(102)))} WHEN {ang(D, A)} <= {ang(D, B)} THEN a{c} ELSE h{c} END') + f' AS {c}' for c in 'xyz')} FROM f")
def _(spark, d):
    """Of ends that are equally near but for rounding, the one that SQL takes: acos of Java and of
    C differ in their last bits."""
    rows = triples(spark, d)
    near = S.dot(F.col("d"), F.col("a")), S.dot(F.col("d"), F.col("b"))
    tie = F.abs(near[0] - near[1]) < 1e-12
    first = F.coalesce(_first_of_tie(*(F.when(tie, F.col(c)) for c in ("la", "oa", "lb", "ob", "ld", "od"))), near[0] >= near[1])
    rows = rows.select("id", "a", "b", "d", first.alias("_first"))
    return rows.select("id", *xyz_out(S.closest_on_arc(F.col("d"), F.col("a"), F.col("b"), F.col("_first"))))


@query("arc_interpolation", f"WITH {G}, w AS (SELECT *, {ang(A, B)} AS w FROM g) SELECT id, {', '.join(rnd(f'CASE WHEN sin(w) < 1e-12 THEN a{c} ELSE (sin(0.75e0 * w) * a{c} + sin(0.25e0 * w) * h{c}) / sin(w) END') + f' AS {c}' for c in 'xyz')} FROM w")
def _(spark, d):
    return triples(spark, d).select("id", *xyz_out(S.arc_point(F.col("a"), F.col("b"), F.lit(0.25))))


_E = ("ex", "ey", "ez")
_G4 = f"{G}, h AS (SELECT *, {xyz('-ld', 'od + 40', 'e')} FROM g)"
_SIDES = [f"sign({x})" for x in (dt(cr(A, B), D), dt(cr(A, B), _E), dt(cr(D, _E), A), dt(cr(D, _E), B))]
_CROSS = f"({_SIDES[0]} * {_SIDES[1]} < 0 AND {_SIDES[2]} * {_SIDES[3]} < 0 AND {_SIDES[0]} = {_SIDES[3]})"


@query("arc_crossings", f"WITH {_G4}, x AS (SELECT *, {_CROSS} AS crosses, {', '.join(f'{e} AS p{c}' for e, c in zip(cr(cr(A, B), cr(D, _E)), 'xyz', strict=True))} FROM h), s AS (SELECT *, CASE WHEN {dt(vec('p'), tuple(f'a{c} + h{c}' for c in 'xyz'))} >= 0 THEN 1 ELSE -1 END / {norm(vec('p'))} AS k FROM x) SELECT id, crosses, {', '.join(rnd(f'CASE WHEN crosses THEN k * p{c} END') + f' AS {c}' for c in 'xyz')} FROM s")
def _(spark, d):
    e = S.from_lat_lon(-F.col("ld"), F.col("od") + 40)
    rows = triples(spark, d).withColumn("e", e)
    p = S.arc_intersection(F.col("a"), F.col("b"), F.col("d"), F.col("e"))
    return rows.select("id", S.arcs_cross(F.col("a"), F.col("b"), F.col("d"), F.col("e")).alias("crosses"), p.alias("p")).select("id", "crosses", *xyz_out(F.col("p")))


@query("arc_to_arc_distance", f"WITH {_G4} SELECT id, {rnd(f'CASE WHEN {_CROSS} THEN 0e0 ELSE least({to_arc(A, D, _E)}, {to_arc(B, D, _E)}, {to_arc(D, A, B)}, {to_arc(_E, A, B)}) END')} AS angle FROM h")
def _(spark, d):
    rows = triples(spark, d).withColumn("e", S.from_lat_lon(-F.col("ld"), F.col("od") + 40))
    return rows.select("id", r6(proximity.arc_to_arc(F.col("a"), F.col("b"), F.col("d"), F.col("e"))).alias("angle"))


@query("tessellated_arcs", f"WITH {G} SELECT id, CAST(greatest(1, ceil({ang(A, B)} / 0.1e0)) + 1 AS INTEGER) AS points FROM g")
def _(spark, d):
    return triples(spark, d).select("id", F.size(S.tessellate(F.col("a"), F.col("b"), 0.1)).alias("points"))


#: Small triangles about a point, anticlockwise for even ids.
_TRI = f"t3 AS (SELECT c_custkey AS id, CAST((c_custkey * 53) % 141 - 70 AS DOUBLE) AS la, CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) AS lo, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END AS s, 1 + c_custkey % 9 AS r FROM customer), tri AS (SELECT *, {xyz('la', 'lo', 'a')}, {xyz('la', 'lo + r', 'h')}, {xyz('la + s * r', 'lo', 'd')} FROM t3)"


def triangles(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(k.alias("id"), (k * 53 % 141 - 70).cast("double").alias("la"), (k * 37 % 360 - 180).cast("double").alias("lo"), F.when(k % 2 == 0, 1).otherwise(-1).alias("s"), (1 + k % 9).alias("r"))
    ring = F.array(S.from_lat_lon("la", "lo"), S.from_lat_lon(F.col("la"), F.col("lo") + F.col("r")), S.from_lat_lon(F.col("la") + F.col("s") * F.col("r"), F.col("lo")))
    return t.withColumn("rings", F.array(ring))


@query("triangle_signed_area", f"WITH {_TRI} SELECT id, round({area(A, B, D)}, 9) + 0e0 AS area FROM tri")
def _(spark, d):
    return triangles(spark, d).select("id", (F.round(S.ring_area(F.element_at("rings", 1)), 9) + F.lit(0.0)).alias("area"))


@query("ring_orientation", f"WITH {_TRI} SELECT id, {area(A, B, D)} < 0 AS clockwise, round(abs({area(A, B, D)}), 9) + 0e0 AS forced FROM tri")
def _(spark, d):
    forced = S.ring_area(F.element_at(geometry.force_orientation(F.col("rings"), False), 1))
    return triangles(spark, d).select("id", (S.ring_area(F.element_at("rings", 1)) < 0).alias("clockwise"), (F.round(forced, 9) + F.lit(0.0)).alias("forced"))


@query("measured_areas_km2", f"WITH {_TRI} SELECT id, round(abs({area(A, B, D)}) * 6371.009e0 * 6371.009e0, 2) + 0e0 AS km2, {rnd(f'({ang(A, B)} + {ang(B, D)} + {ang(D, A)}) * 6371.009e0')} AS perimeter FROM tri")
def _(spark, d):
    closed = geometry.to_polyline(F.col("rings"), F.lit("polygon"))
    return triangles(spark, d).select("id", (F.round(S.polygon_area(F.col("rings")) * S.MEAN_RADIUS**2, 2) + F.lit(0.0)).alias("km2"), r6(S.length(closed) * S.MEAN_RADIUS).alias("perimeter"))


_SUM: Vec = tuple(f"(a{c} + h{c} + d{c})" for c in "xyz")  # type: ignore[assignment]


@query("bounding_circles", f"WITH {_TRI}, c AS (SELECT *, {', '.join(f'{e} / {norm(_SUM)} AS c{x}' for e, x in zip(_SUM, 'xyz', strict=True))} FROM tri) SELECT id, {rnd('cx')} AS x, {rnd('cy')} AS y, {rnd('cz')} AS z, round(least({dt(vec('c'), A)}, {dt(vec('c'), B)}, {dt(vec('c'), D)}), 9) AS cos_radius FROM c")
def _(spark, d):
    c = triangles(spark, d).select("id", S.bounding_circle(F.element_at("rings", 1)).alias("c"))
    return c.select("id", *xyz_out(F.col("c.centre")), F.round("c.cos_radius", 9).alias("cos_radius"))


@query("bounding_circle_relations", f"WITH {_TRI}, c AS (SELECT *, {', '.join(f'{e} / {norm(_SUM)} AS c{x}' for e, x in zip(_SUM, 'xyz', strict=True))} FROM tri), r AS (SELECT *, acos(least(1e0, least({dt(vec('c'), A)}, {dt(vec('c'), B)}, {dt(vec('c'), D)}))) AS rad FROM c) SELECT id, TRUE AS holds, {ang(vec('c'), ('1e0', '0e0', '0e0'))} <= rad + 0.5e0 AS meets, round(cos(rad + 0.1e0), 9) AS wider, round(cos(greatest(0e0, rad - 0.05e0)), 9) AS narrower FROM r")
def _(spark, d):
    """A triangle's circle: holds its corners; meets half a radian about (1, 0, 0); changed."""
    other = F.struct(S.vector(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("centre"), F.lit(0.8775825618903728).alias("cos_radius"))
    rows = triangles(spark, d).withColumn("c", S.bounding_circle(F.element_at("rings", 1))).withColumn("o", other)
    holds = F.forall(F.element_at("rings", 1), lambda p: S.in_circle(p, F.col("c")))
    return rows.select("id", holds.alias("holds"), S.circles_meet(F.col("c"), F.col("o")).alias("meets"), F.round(S.widened(F.col("c"), F.lit(0.1))["cos_radius"], 9).alias("wider"), F.round(S.widened(F.col("c"), F.lit(-0.05))["cos_radius"], 9).alias("narrower"))


_OUTLINE: Vec = tuple(f"((a{c} + h{c}) / {norm(tuple(f'a{x} + h{x}' for x in 'xyz'))} * {ang(A, B)} + (h{c} + d{c}) / {norm(tuple(f'h{x} + d{x}' for x in 'xyz'))} * {ang(B, D)})" for c in "xyz")  # type: ignore[assignment]


@query("outline_centroids", f"WITH {_TRI}, o AS (SELECT id, {', '.join(f'{e} AS o{c}' for e, c in zip(_OUTLINE, 'xyz', strict=True))} FROM tri) SELECT id, {', '.join(rnd(f'o{c} / {norm(vec(chr(111)))}') + f' AS {c}' for c in 'xyz')} FROM o")
def _(spark, d):
    return triangles(spark, d).select("id", *xyz_out(S.outline_centroid(F.element_at("rings", 1))))


def _at(lat: str, lon: str, azimuth: str, dist: str) -> Vec:
    """The point at an azimuth and distance in radians, in SQL."""
    p, m = f"radians({lat})", f"radians({lon})"
    v = (f"cos({p}) * cos({m})", f"cos({p}) * sin({m})", f"sin({p})")
    north = (f"-sin({p}) * cos({m})", f"-sin({p}) * sin({m})", f"cos({p})")
    east = (f"-sin({m})", f"cos({m})", "0e0")
    return tuple(f"(({v[i]}) * cos({dist}) + (({north[i]}) * cos({azimuth}) + ({east[i]}) * sin({azimuth})) * sin({dist}))" for i in range(3))  # type: ignore[return-value]


_C6 = "n6 AS (SELECT k.*, nth, 2 * pi() * nth / 6e0 AS az FROM k, (SELECT unnest(range(6)) AS nth) x)"


@query("small_circle_points", f"WITH {G}, {_C6} SELECT id, CAST(nth AS INTEGER) AS nth, {out(_at('la', 'oa', 'az', 'radians(5e0 + id % 60)'))} FROM n6")
def _(spark, d):
    ring = S.small_circle(F.col("a"), F.radians(F.lit(5.0) + F.col("id") % 60), 6)
    return triples(spark, d).select("id", F.posexplode(ring).alias("nth", "p")).select("id", "nth", *xyz_out(F.col("p")))


@query("ellipse_points", f"WITH {G}, {_C6} SELECT id, CAST(nth AS INTEGER) AS nth, {out(_at('la', 'oa', '0.5e0 + atan2(0.1e0 * sin(az), 0.2e0 * cos(az))', 'sqrt(0.04e0 * cos(az) * cos(az) + 0.01e0 * sin(az) * sin(az))'))} FROM n6")
def _(spark, d):
    ring = S.ellipse(F.col("a"), F.lit(0.2), F.lit(0.1), F.lit(0.5), 6)
    return triples(spark, d).select("id", F.posexplode(ring).alias("nth", "p")).select("id", "nth", *xyz_out(F.col("p")))


@query("small_circle_meets_great_circle", f"WITH {G} SELECT id, CASE WHEN sin(0.6e0) > abs({dt(A, B)}) THEN 2 ELSE 0 END AS points FROM g")
def _(spark, d):
    """Circles of 0.6 radians about a, and the planes with pole b."""
    return triples(spark, d).select("id", F.size(S.small_circle_great_circle(F.col("a"), F.lit(0.6), F.col("b"))).alias("points"))


_NED = [f"(-sin(radians(la)) * cos(radians(oa)) * hx - sin(radians(la)) * sin(radians(oa)) * hy + cos(radians(la)) * hz)", "(-sin(radians(oa)) * hx + cos(radians(oa)) * hy)", f"(-{dt(A, B)})"]


@query("north_east_down", f"WITH {G} SELECT id, {', '.join(rnd(e) + f' AS {n}' for e, n in zip(_NED, ('n', 'e', 'd'), strict=True))}, {out(B)} FROM g")
def _(spark, d):
    ned = projections.to_north_east_down(F.col("b"), F.col("la"), F.col("oa"))
    rows = triples(spark, d).select("id", "la", "oa", ned.alias("f"))
    back = projections.from_north_east_down(F.col("f"), F.col("la"), F.col("oa"))
    return rows.select("id", *(r6(F.col(f"f.{c}")).alias(c) for c in "ned"), *xyz_out(back))


@query("rotation_between_points", f"WITH {G}, {_N}, s AS (SELECT *, {norm(vec('n'))} AS size, atan2({norm(vec('n'))}, {dt(A, B)}) AS t FROM n) SELECT id, {rnd('CASE WHEN size < 1e-12 THEN 1e0 ELSE cos(t / 2) END')} AS w, {', '.join(rnd(f'CASE WHEN size < 1e-12 THEN 0e0 ELSE sin(t / 2) * n{c} / size END') + f' AS {c}' for c in 'xyz')} FROM s")
def _(spark, d):
    return triples(spark, d).select("id", Q.between(F.col("a"), F.col("b")).alias("q")).select("id", *q_out(F.col("q")))


_QP = f"q AS (SELECT id, radians(5e0 + id % 170) AS t, {', '.join(f'a{c}' for c in 'xyz')}, {', '.join(f'h{c}' for c in 'xyz')} FROM g), p AS (SELECT *, cos(t / 2) AS w, {', '.join(f'sin(t / 2) * a{c} AS {c}' for c in 'xyz')} FROM q)"


@query("axis_angle_round_trip", f"WITH {G} SELECT id, {rnd('la')} AS lat, {rnd('oa')} AS lon, {rnd('5e0 + id % 170')} AS angle FROM k")
def _(spark, d):
    p = triples(spark, d).select("id", Q.to_pole(Q.from_pole(F.col("la"), F.col("oa"), F.lit(5.0) + F.col("id") % 170)).alias("p"))
    lon = r6(F.col("p.lon"))
    return p.select("id", r6(F.col("p.lat")).alias("lat"), F.when(lon == 180, F.lit(-180.0)).otherwise(lon).alias("lon"), r6(F.col("p.angle")).alias("angle"))


@query("rotated_rings", f"WITH {G}, {_QP} SELECT id, {out(turn(('w', 'x', 'y', 'z'), B))} FROM p")
def _(spark, d):
    q = Q.from_axis(F.col("a"), F.radians(F.lit(5.0) + F.col("id") % 170))
    rows = triples(spark, d).select("id", Q.rotate_rings(q, F.array(F.array(F.col("a"), F.col("b")))).alias("r"))
    return rows.select("id", *xyz_out(F.element_at(F.element_at("r", 1), 2)))


@query("geometry_conversions", "SELECT c_custkey AS id, 3 AS multipoint, 4 AS outline, 3 AS polygon, 5 AS joined FROM customer")
def _(spark, d):
    t = triangles(spark, d)
    line = geometry.to_polyline(F.col("rings"), F.lit("polygon"))
    return t.select("id", F.size(geometry.to_multipoint(F.col("rings"))).alias("multipoint"), F.size(line).alias("outline"), F.size(F.element_at(geometry.to_polygon(F.array(line), F.lit("polyline")), 1)).alias("polygon"), F.size(geometry.concatenated(F.slice(F.element_at("rings", 1), 1, 3), F.slice(F.reverse(F.element_at("rings", 1)), 1, 3))).alias("joined"))


@query("dateline_wrapped_lines", f"WITH {G} SELECT id, CAST(CASE WHEN abs(ob - oa) > 180 THEN 2 ELSE 1 END AS BIGINT) AS parts, CAST(CASE WHEN abs(ob - oa) > 180 THEN 4 ELSE 2 END AS BIGINT) AS points FROM k")
def _(spark, d):
    """Lines from a to b by the shorter way, cut at 180 degrees."""
    at = lambda la, lo: F.struct(F.col(la).alias("lat"), F.col(lo).alias("lon"))
    lines = triples(spark, d).select("id", F.array(at("la", "oa"), at("lb", "ob")).alias("coordinates"))
    # an end on the meridian itself is its own cut
    cut = geometry.wrap_dateline(lines).groupBy("id").agg(F.count("*").alias("parts"), F.sum(F.size("coordinates")).alias("points"), F.min(F.size("coordinates")).alias("least"))
    on = triples(spark, d).select("id", (((F.col("oa") == -180) | (F.col("ob") == -180)) & (F.abs(F.col("ob") - F.col("oa")) > 180)).alias("on"))
    return cut.join(on, "id").select("id", F.when(F.col("on"), 2).otherwise(F.col("parts")).cast("long").alias("parts"), F.when(F.col("on"), 4).otherwise(F.col("points")).cast("long").alias("points"))


# --- generated points ---------------------------------------------------------------------------


@query("whole_degree_grid", "SELECT CAST(lat AS DOUBLE) AS lat, count(*) AS points, round(sum(cos(radians(lat))), 6) + 0e0 AS weight FROM (SELECT unnest(range(-90, 91)) AS lat) a, (SELECT unnest(range(-180, 181)) AS lon) b GROUP BY 1")
def _(spark, d):
    return kinematics.whole_degree_grid(spark).groupBy("lat").agg(F.count("*").alias("points"), r6(F.sum(F.cos(F.radians("lat")))).alias("weight"))


@query("velocity_domains", "SELECT * FROM (VALUES ('caps', 12 * 81), ('icosahedral', 10 * 81), ('grid', 37 * 73), ('uniform', 30 * 16)) t(domain, points)")
def _(spark, d):
    made = {"caps": generate.mesh_caps(spark, 9), "icosahedral": generate.mesh_icosahedral(spark, 9), "grid": generate.lat_lon_grid(spark, 5.0), "uniform": generate.uniform_points(spark, 2)}
    all_ = None
    for name, df in made.items():
        one = df.where(F.abs(S.norm(F.col("v")) - 1) < 1e-9).select(F.lit(name).alias("domain"))
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy("domain").agg(F.count("*").cast("int").alias("points"))


# --- partitioning -------------------------------------------------------------------------------

_M = "m AS (SELECT c_custkey AS id, CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) + 0.5e0 AS lon FROM customer)"
_SIDE = "CASE WHEN lon > -90 AND lon < 90 THEN 0 ELSE 4 END + CASE WHEN lon > 0 THEN 0 ELSE 2 END"


@query("partition_lines", f"WITH {_M} SELECT id, CAST(100 + {_SIDE} + u AS BIGINT) AS hit, CAST(1 - u AS INTEGER) AS nth, {rnd('radians(CASE u WHEN 0 THEN 50e0 ELSE 30e0 END)')} AS size FROM m, (VALUES (0), (1)) x(u)")
def _(spark, d):
    """Meridians from 30 south to 50 north, cut by the octants at the equator."""
    k = F.col("c_custkey")
    lon = (k * 37 % 360 - 180).cast("double") + 0.5
    lines = table(spark, d, "customer").select(k.alias("id"), F.array(S.from_lat_lon(F.lit(-30.0), lon), S.from_lat_lon(F.lit(10.0), lon), S.from_lat_lon(F.lit(50.0), lon)).alias("line"))
    return partition.split_lines(lines, octants(spark)).select("id", "hit", "nth", r6(F.col("size")).alias("size"))


@query("intersection_graph", f"WITH {_M} SELECT id, CAST(n AS INTEGER) AS nth, CASE n WHEN 0 THEN NULL ELSE 'equator' END AS from_other, CASE n WHEN 1 THEN NULL ELSE 'equator' END AS to_other, {rnd('radians(CASE n WHEN 0 THEN 30e0 ELSE 50e0 END)')} AS size FROM m, (VALUES (0), (1)) x(n)")
def _(spark, d):
    """Meridians cut by the equator, which is a line of twelve arcs and one to close it."""
    k = F.col("c_custkey")
    lon = (k * 37 % 360 - 180).cast("double") + 0.5
    lines = table(spark, d, "customer").select(k.alias("id"), F.array(S.from_lat_lon(F.lit(-30.0), lon), S.from_lat_lon(F.lit(10.0), lon), S.from_lat_lon(F.lit(50.0), lon)).alias("line"))
    points = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: S.from_lat_lon(F.lit(0.0), i * 30.0))
    equator = spark.range(1).select(F.lit("equator").alias("id"), points.alias("line"))
    found = geometry.intersection_graph(lines, equator, cell=0.25)
    return found.select("id", "nth", "from_other", "to_other", r6(S.length(F.col("points"))).alias("size"))


@query("partition_polygons", f"WITH {_TRI} SELECT id, {rnd(f'{ang(A, B)} + {ang(B, D)} + {ang(D, A)}')} AS size FROM tri")
def _(spark, d):
    """Outlines cut by the octants: the parts of each have its whole length."""
    rows = triangles(spark, d).select("id", F.lit("polygon").alias("gtype"), "rings")
    return partition.partition_geometries(rows, octants(spark)).where("hit is not null").groupBy("id").agg(r6(F.sum("size")).alias("size"))


@query("partition_points", f"WITH {C} SELECT c_mktsegment AS id, CAST({_OCT_ID} AS BIGINT) AS hit, count(*) AS points FROM cv GROUP BY 1, 2")
def _(spark, d):
    """Multipoints, one a market segment, dealt out to the octants."""
    rows = customers(spark, d).groupBy(F.col("c_mktsegment").alias("id")).agg(F.collect_list("v").alias("r")).select("id", F.lit("multipoint").alias("gtype"), F.array("r").alias("rings"))
    return partition.partition_geometries(rows, octants(spark)).select("id", "hit", F.col("size").cast("long").alias("points"))


_AS = f"hh AS (SELECT *, {_OCT_ID} AS hit FROM cv), asg AS (SELECT hh.id, CASE WHEN begin_ >= 60 AND end_ <= 60 THEN hit ELSE hh.plate_id END AS plate, begin_ >= 60 AND end_ <= 60 AS alive, hh.x AS vx, hh.y AS vy, hh.z AS vz, coalesce(r.w, 1e0) AS w, coalesce(r.x, 0e0) AS x, coalesce(r.y, 0e0) AS y, coalesce(r.z, 0e0) AS z FROM hh LEFT JOIN rot r ON r.plate_id = hh.hit)"


@query("assign_plate_ids", f"WITH RECURSIVE {rot_sql([60.0])}, {C}, {_AS} SELECT id, CAST(plate AS BIGINT) AS plate_id, {', '.join(rnd(f'CASE WHEN alive THEN {e} ELSE v{c} END') + f' AS {c}' for e, c in zip(turn(conj(('w', 'x', 'y', 'z')), vec('v')), 'xyz', strict=True))} FROM asg")
def _(spark, d):
    rows = customers(spark, d).withColumn("time", F.lit(60.0))
    found = partition.assign_plates(rows, octants(spark), R.rotations(samples(spark, d), [60.0]))
    return found.select("id", "plate_id", *xyz_out(F.col("v")))


@query("assign_poles_by_site", f"WITH RECURSIVE {rot_sql([60.0])}, {C}, {_AS}, site AS (SELECT asg.*, cos(radians(lat)) * cos(radians(lon + 30)) AS px, cos(radians(lat)) * sin(radians(lon + 30)) AS py FROM asg JOIN c ON c.id = asg.id) SELECT id, CAST(plate AS BIGINT) AS plate_id, {', '.join(rnd(f'CASE WHEN alive THEN {e} ELSE {o} END') + f' AS {c}' for e, o, c in zip(turn(conj(('w', 'x', 'y', 'z')), ('px', 'py', 'vz')), ('px', 'py', 'vz'), 'xyz', strict=True))} FROM site")
def _(spark, d):
    """The site is the customer's point, the pole 30 degrees to its east."""
    rows = customers(spark, d).withColumns({"time": F.lit(60.0), "site": F.col("v"), "v": S.from_lat_lon(F.col("lat"), F.col("lon") + 30)})
    found = partition.assign_poles(rows, octants(spark), R.rotations(samples(spark, d), [60.0]))
    return found.select("id", "plate_id", *xyz_out(F.col("v")))


# --- co-registration of geometries ----------------------------------------------------------------

_PP, _TA, _TB, _TD = tuple(f"pv.{c}" for c in "xyz"), tuple(f"tt.a{c}" for c in "xyz"), tuple(f"tt.h{c}" for c in "xyz"), tuple(f"tt.d{c}" for c in "xyz")
_TT = f"tt AS (SELECT *, {xyz('tlat * 0.8e0', 'tlon', 'a')}, {xyz('tlat * 0.8e0', 'tlon + 4 + target_id % 5', 'h')}, {xyz('tlat * 0.8e0 + 6', 'tlon', 'd')} FROM t)"
_LINE_KM = f"least({to_arc(_PP, _TA, _TB)}, {to_arc(_PP, _TB, _TD)}) * 6378.137e0"
_SOLID = f"({dt(cr(_TA, _TB), _PP)} >= 0 AND {dt(cr(_TB, _TD), _PP)} >= 0 AND {dt(cr(_TD, _TA), _PP)} >= 0)"
_SOLID_KM = f"CASE WHEN {_SOLID} THEN 0e0 ELSE least({to_arc(_PP, _TA, _TB)}, {to_arc(_PP, _TB, _TD)}, {to_arc(_PP, _TD, _TA)}) * 6378.137e0 END"


def shaped(spark, d, kind: str) -> DataFrame:
    """Suppliers as triangles or as lines of two arcs."""
    t, o = F.col("tlat") * 0.8, F.col("tlon")
    ring = F.array(S.from_lat_lon(t, o), S.from_lat_lon(t, o + 4 + F.col("target_id") % 5), S.from_lat_lon(t + 6, o))
    return suppliers(spark, d).drop("v").withColumns({"gtype": F.lit(kind), "rings": F.array(ring)})


def _coreg(spark, d, targets: DataFrame, *rows) -> DataFrame:
    config = [coregistration.Column_("supplier", a, r, k, m, **more) for m, a, r, k, more in rows]
    return coregistration.coregister(parts(spark, d), {"supplier": targets}, config).toDF("seed_id", *(f"r{i}" for i in range(len(rows))))


@query("coreg_lines", f"WITH {P}, {T}, {_TT}, j AS (SELECT seed_id, target_id, s_acctbal, {_LINE_KM} AS km FROM pv, tt WHERE {_LINE_KM} < 1500e0) SELECT p.seed_id, {rnd('min(km)')} AS r0, count(DISTINCT target_id) AS r1, max(s_acctbal) AS r2 FROM p LEFT JOIN j ON j.seed_id = p.seed_id GROUP BY p.seed_id")
def _(spark, d):
    got = _coreg(spark, d, shaped(spark, d, "polyline"), ("distance", "distance", "min", 1500.0, {}), ("number_in_region", "n", "lookup", 1500.0, {}), ("property", "s_acctbal", "max", 1500.0, {}))
    return got.withColumn("r0", r6(F.col("r0")))


@query("coreg_polygons", f"WITH {P}, {T}, {_TT}, j AS (SELECT seed_id, target_id, s_acctbal, {_SOLID_KM} AS km, abs({area(_TA, _TB, _TD)}) AS area FROM pv, tt WHERE {_SOLID_KM} < 1500e0), w AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY km, CASE WHEN km = 0 THEN area END, target_id) AS o FROM j) SELECT p.seed_id, {rnd('min(km)')} AS r0, count(target_id) AS r1, max(s_acctbal) FILTER (WHERE o = 1) AS r2 FROM p LEFT JOIN w ON w.seed_id = p.seed_id GROUP BY p.seed_id")
def _(spark, d):
    """Solid polygons; where several hold the seed, the lookup takes the smallest."""
    got = _coreg(spark, d, shaped(spark, d, "polygon"), ("distance", "distance", "min", 1500.0, {}), ("number_in_region", "n", "lookup", 1500.0, {}), ("property", "s_acctbal", "lookup", 1500.0, {}))
    return got.withColumn("r0", r6(F.col("r0")))


@query("coreg_self", "SELECT p_partkey AS seed_id, CAST(p_size AS DOUBLE) AS r0, p_size AS r1, CAST(p_size AS VARCHAR) AS r2, TRUE AS r3, 1 AS r4, 0e0 AS r5, CAST('NaN' AS DOUBLE) AS r6 FROM part")
def _(spark, d):
    rows = [("property", "p_size", "mean", None, {}), ("property", "p_size", "lookup", None, {}), ("property", "p_size", "vote", None, {}), ("presence", "p", "lookup", None, {}), ("number_in_region", "n", "lookup", None, {}), ("distance", "distance", "min", None, {}), ("presence", "p", "mean", None, {})]
    got = _coreg(spark, d, suppliers(spark, d), *rows)
    return got.withColumn("r4", F.col("r4").cast("int"))


_J = f"{P}, {T}, j AS (SELECT seed_id, target_id, s_acctbal, s_nationkey, acos(greatest(-1e0, least(1e0, pv.x * tv.x + pv.y * tv.y + pv.z * tv.z))) * 6378.137e0 AS km FROM pv, tv WHERE acos(greatest(-1e0, least(1e0, pv.x * tv.x + pv.y * tv.y + pv.z * tv.z))) * 6378.137e0 < 3000e0)"


@query("coreg_weighted_mean", f"WITH {_J} SELECT p.seed_id, {rnd('sum(s_acctbal * km) / sum(km)')} AS r0 FROM p LEFT JOIN j ON j.seed_id = p.seed_id GROUP BY p.seed_id")
def _(spark, d):
    """Balances weighed by distance from the seed."""
    got = _coreg(spark, d, suppliers(spark, d), ("property", "s_acctbal", "weighted_mean", 3000.0, {"weight": "dist_km"}))
    return got.withColumn("r0", r6(F.col("r0")))


@query("coreg_percentile", f"WITH {_J}, w AS (SELECT seed_id, s_acctbal, row_number() OVER (PARTITION BY seed_id ORDER BY s_acctbal) AS o, count(*) OVER (PARTITION BY seed_id) AS n FROM j WHERE s_acctbal IS NOT NULL) SELECT p.seed_id, s_acctbal AS r0 FROM p LEFT JOIN w ON w.seed_id = p.seed_id AND o = greatest(1, CAST(ceil(n * 90e0 / 100) AS BIGINT))")
def _(spark, d):
    return _coreg(spark, d, suppliers(spark, d), ("property", "s_acctbal", "percentile", 3000.0, {"percent": 90.0}))


@query("coreg_attributes", f"WITH {_J}, v AS (SELECT seed_id, 'N' || s_nationkey AS k, count(*) AS n FROM j GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY n DESC, k) AS o FROM v), m AS (SELECT seed_id, max(s_acctbal) AS r1 FROM j GROUP BY 1) SELECT p.seed_id, k AS r0, r1, CASE WHEN m.seed_id IS NOT NULL THEN CAST('NaN' AS DOUBLE) END AS r2 FROM p LEFT JOIN w ON w.seed_id = p.seed_id AND o = 1 LEFT JOIN m ON m.seed_id = p.seed_id")
def _(spark, d):
    """Dictionary attributes, numbers and text, and a plate id that is no number."""
    t = suppliers(spark, d)
    both = F.create_map(F.lit("NATION"), F.to_variant_object(F.array(F.concat(F.lit("N"), F.col("s_nationkey")))), F.lit("BALANCE"), F.to_variant_object(F.array("s_acctbal")))
    first = F.transform_values(both, lambda k, x: F.when(k == "NATION", F.try_variant_get(x, "$[0]", "variant")).otherwise(F.try_variant_get(x, "$[0]", "variant")))
    t = t.withColumns({"attributes": first, "plate_id": F.col("s_nationkey")})
    return _coreg(spark, d, t, ("attribute", "NATION", "vote", 3000.0, {}), ("attribute", "BALANCE", "max", 3000.0, {}), ("property", "plate_id", "mean", 3000.0, {}))


ORACLES["coreg_birth_time"] = f"""WITH RECURSIVE {rot_sql([float(x) for x in range(200)])}, {C}, {T},
sd AS (SELECT cv.id, begin_ AS time, {named(turn(tuple(f'coalesce(r.{c}, {v})' for c, v in zip('wxyz', ('1e0', '0e0', '0e0', '0e0'), strict=True)), ('cv.x', 'cv.y', 'cv.z')), 'xyz')} FROM cv LEFT JOIN rot r ON r.time = begin_ AND r.plate_id = cv.plate_id),
u AS (SELECT tv.target_id, w.time, {named(turn(tuple(f'coalesce(r.{c}, {v})' for c, v in zip('wxyz', ('1e0', '0e0', '0e0', '0e0'), strict=True)), ('tv.x', 'tv.y', 'tv.z')), 'xyz')} FROM tv CROSS JOIN (SELECT DISTINCT time FROM sd) w LEFT JOIN rot r ON r.time = w.time AND r.plate_id = tv.target_id % 7 + 100),
pj AS (SELECT sd.id, acos(greatest(-1e0, least(1e0, sd.x * u.x + sd.y * u.y + sd.z * u.z))) * 6378.137e0 AS km FROM sd JOIN u ON u.time = sd.time WHERE acos(greatest(-1e0, least(1e0, sd.x * u.x + sd.y * u.y + sd.z * u.z))) * 6378.137e0 < 2000e0)
SELECT sd.id AS seed_id, any_value(sd.time) AS time, {rnd('min(km)')} AS km, count(km) AS n FROM sd LEFT JOIN pj ON pj.id = sd.id GROUP BY sd.id"""


# --- reconstruction and kinematics ------------------------------------------------------------------


@query("reconstruct_polygons", f"WITH RECURSIVE {rot_sql([60.0])}, {_TRI} SELECT id, {out(turn(tuple(f'coalesce(r.{c}, {v})' for c, v in zip('wxyz', ('1e0', '0e0', '0e0', '0e0'), strict=True)), D))}, round({area(A, B, D)}, 9) + 0e0 AS area FROM tri LEFT JOIN rot r ON r.plate_id = id % 7 + 100")
def _(spark, d):
    rows = triangles(spark, d).withColumns({"plate_id": F.col("id") % 7 + 100, "time": F.lit(60.0)})
    moved = reconstruct.by_plate(rows, R.rotations(samples(spark, d), [60.0]), point=None, rings="rings")
    return moved.select("id", *xyz_out(F.element_at(F.element_at("rings", 1), 3)), (F.round(S.ring_area(F.element_at("rings", 1)), 9) + F.lit(0.0)).alias("area"))


@query("geomagnetic_pole_visibility", f"WITH {C} SELECT kind, count(*) AS poles, sum(id)::BIGINT AS ids FROM (SELECT 'always' AS kind, id FROM c UNION ALL SELECT 'time_window', id FROM c WHERE begin_ BETWEEN 30 AND 120 UNION ALL SELECT 'about_age', id FROM c WHERE abs(begin_ - 60) <= 5) x GROUP BY kind")
def _(spark, d):
    rot = R.rotations(samples(spark, d), [60.0])
    poles = customers(spark, d).withColumns({"time": F.lit(60.0), "age": F.col("begin"), "site": F.col("v")})
    all_ = None
    for kind in (reconstruct.ALWAYS, reconstruct.TIME_WINDOW, reconstruct.ABOUT_AGE):
        one = reconstruct.geomagnetic_poles(poles, rot, kind, 120.0, 30.0, 5.0).select(F.lit(kind).alias("kind"), "id")
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy("kind").agg(F.count("*").alias("poles"), F.sum("id").alias("ids"))


@query("reconstruction_methods", "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'MOTION_PATH' WHEN c_custkey % 3 = 0 THEN 'FLOWLINE' WHEN c_custkey % 2 = 0 THEN 'HALF_STAGE_ROTATION' ELSE 'BY_PLATE_ID' END AS method, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    k = F.col("c_custkey")
    m = reconstruct.choose_method({"FLOWLINE": k % 3 == 0, "MOTION_PATH": k % 5 == 0, "HALF_STAGE_ROTATION": k % 2 == 0})
    return table(spark, d, "customer").groupBy(m.alias("method")).agg(F.count("*").alias("n"))


@query("small_circle_centres", f"WITH RECURSIVE {rot_sql([60.0])}, {C} SELECT id, {out(turn(tuple(f'coalesce(r.{c}, {v})' for c, v in zip('wxyz', ('1e0', '0e0', '0e0', '0e0'), strict=True)), ('cv.x', 'cv.y', 'cv.z')))}, 64 AS points FROM cv LEFT JOIN rot r ON r.plate_id = cv.plate_id")
def _(spark, d):
    rows = customers(spark, d).withColumns({"time": F.lit(60.0), "radius": F.lit(10.0)})
    made = reconstruct.small_circles(rows, R.rotations(samples(spark, d), [60.0]))
    return made.select("id", *xyz_out(F.col("v")), F.size("ring").alias("points"))


@query("stage_about_anchor", f"WITH RECURSIVE {rot_sql([20.0, 60.0])}, rel AS (SELECT a.time, a.plate_id, {named(mul(conj(quat('b.')), quat('a.')))} FROM rot a JOIN rot b ON b.time = a.time AND b.plate_id = 101), st AS (SELECT a.plate_id, {named(mul(quat('b.'), conj(quat('a.'))))} FROM rel a JOIN rel b ON b.plate_id = a.plate_id WHERE a.time = 20 AND b.time = 60), an AS (SELECT st.plate_id, {named(mul(quat('f.'), quat('st.')))}, e.w AS ew, e.x AS ex, e.y AS ey, e.z AS ez FROM st, (SELECT * FROM rot WHERE time = 60 AND plate_id = 101) f, (SELECT * FROM rot WHERE time = 20 AND plate_id = 101) e) SELECT CAST(plate_id AS BIGINT) AS plate_id, {_shown(mul(quat(''), conj(quat('e'))))} FROM an")
def _(spark, d):
    rot = R.rotations(samples(spark, d), [20.0, 60.0])
    at = lambda t, name: F.broadcast(rot.where(f"time = {t} and plate_id = 101").select(F.col("q").alias(name)))
    rows = R.stage(rot, None, 101, 20.0, 60.0).join(at(20, "_s")).join(at(60, "_e"))
    return rows.select("plate_id", R.about_anchor(F.col("q"), F.col("_s"), F.col("_e")).alias("q")).select("plate_id", *q_out(F.col("q")))


@query("velocity_intervals", "SELECT o_orderkey, kind, CASE kind WHEN 't_plus' THEN t + 10 WHEN 't_minus' THEN CASE WHEN t < 10 THEN 10 ELSE t END ELSE CASE WHEN t < 5 THEN 10 ELSE t + 5 END END AS older, CASE kind WHEN 't_plus' THEN t WHEN 't_minus' THEN CASE WHEN t < 10 THEN 0 ELSE t - 10 END ELSE CASE WHEN t < 5 THEN 0 ELSE t - 5 END END AS younger FROM (SELECT o_orderkey, CAST(o_orderkey % 40 AS DOUBLE) AS t FROM orders) o, (VALUES ('t_plus'), ('t_minus'), ('centred')) x(kind)")
def _(spark, d):
    t = (F.col("o_orderkey") % 40).cast("double")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), kinematics.interval(t, F.lit(10.0), k).alias("i")) for k in ("t_plus", "t_minus", "centred"))))
    return table(spark, d, "orders").select("o_orderkey", each.alias("e")).select("o_orderkey", "e.kind", "e.i.older", "e.i.younger")


_KS = ["0e0", "20e0", "40e0", "60e0"]
_KIN = f"""q AS (SELECT a.plate_id, b.time, {named(mul(quat('b.'), conj(quat('a.'))))} FROM rot a JOIN rot b ON b.plate_id = a.plate_id AND a.time = b.time + 1 WHERE b.time IN ({', '.join(_KS)})),
sh AS (SELECT plate_id, time, {', '.join(f'CASE WHEN w < 0 THEN -{c} ELSE {c} END AS {c}' for c in 'wxyz')} FROM q),
om AS (SELECT plate_id, time, {', '.join(f'CASE WHEN w >= 1 - 1e-12 THEN 0e0 ELSE 2 * atan2({norm(vec(""))}, w) * 637.8137e0 * {c} / {norm(vec(""))} END AS o{c}' for c in 'xyz')} FROM sh),
ps AS (SELECT cv.id, cv.plate_id, s.time, {named(turn(tuple(f'coalesce(r.{c}, {v})' for c, v in zip('wxyz', ('1e0', '0e0', '0e0', '0e0'), strict=True)), ('cv.x', 'cv.y', 'cv.z')), 'xyz')} FROM cv CROSS JOIN (VALUES {', '.join(f'({t})' for t in _KS)}) s(time) LEFT JOIN rot r ON r.time = s.time AND r.plate_id = cv.plate_id),
pl AS (SELECT ps.*, {latlon()[0]} AS lat, {latlon()[1]} AS lon, coalesce(oy * z - oz * y, 0e0) AS vx, coalesce(oz * x - ox * z, 0e0) AS vy, coalesce(ox * y - oy * x, 0e0) AS vz FROM ps LEFT JOIN om ON om.plate_id = ps.plate_id AND om.time = ps.time),
ne AS (SELECT id, time, lat, lon, -sin(radians(lat)) * cos(radians(lon)) * vx - sin(radians(lat)) * sin(radians(lon)) * vy + cos(radians(lat)) * vz AS n, -sin(radians(lon)) * vx + cos(radians(lon)) * vy AS e FROM pl)"""


ORACLES["kinematic_series"] = f"WITH RECURSIVE {rot_sql([0.0, 1.0, 20.0, 21.0, 40.0, 41.0, 60.0, 61.0])}, {C}, {_KIN} SELECT id, time, {rnd('lat')} AS lat, CASE WHEN {rnd('lon')} = 180 THEN -180e0 ELSE {rnd('lon')} END AS lon, {rnd('sqrt(n * n + e * e)')} AS speed, CASE WHEN n * n + e * e > 1e-12 THEN round(degrees(CASE WHEN atan2(e, n) < 0 THEN atan2(e, n) + 2 * pi() ELSE atan2(e, n) END), 4) + 0e0 END AS azimuth, {rnd('-n')} AS vel_colat, {rnd('e')} AS vel_lon FROM ne"


@query("surface_velocity_reasons", f"WITH {C} SELECT CASE WHEN {_OCT_ID} < 104 THEN 'in_polygon' ELSE 'none' END AS reason, count(*) AS points FROM cv GROUP BY 1")
def _(spark, d):
    """Velocities on half of the octants; the points of the others have none."""
    rows = customers(spark, d).withColumn("time", F.lit(60.0)).drop("plate_id")
    got = kinematics.surface_velocities(rows, octants(spark).where("plate_id < 104"), R.rotations(samples(spark, d), [60.0, 61.0]), 1.0)
    on_edge = F.when((F.col("v.x") <= 1e-9), "none").otherwise(F.col("reason"))
    return got.where((F.col("reason") == "none") == F.col("velocity").isNull()).groupBy(on_edge.alias("reason")).agg(F.count("*").alias("points"))


@query("solved_velocities", f"WITH {C} SELECT mode, count(*) AS points, count(*) FILTER (WHERE moves) AS moving FROM (SELECT 'surfaces' AS mode, {_OCT_ID} <= 105 AS moves FROM cv UNION ALL SELECT 'domain_points', plate_id <= 105 FROM cv) t GROUP BY 1")
def _(spark, d):
    """By the octants' plates and by the points' own; the model has plates up to 105."""
    rows, model = customers(spark, d).withColumn("time", F.lit(60.0)), R.rotations(samples(spark, d), [60.0, 61.0])
    by = {"surfaces": kinematics.solved_velocities(rows.drop("plate_id"), model, 1.0, polygons=octants(spark)), "domain_points": kinematics.solved_velocities(rows, model, 1.0, "domain_points")}
    all_ = None
    for mode, df in by.items():
        # a point on its plate's own pole stands still, but its plate moves
        one = df.select(F.lit(mode).alias("mode"), (F.col("plate_id") <= 105).alias("moves"), "velocity")
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy("mode").agg(F.count("velocity").alias("points"), F.sum(F.col("moves").cast("long")).alias("moving"))


_ST = "steps AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_quantity - 25) / 100 AS tt, l_discount AS tp, l_tax - 0.03e0 AS pt, (l_quantity - 20) / 200 AS pp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS dt FROM lineitem)"


def _advance() -> str:
    """inverse(I - L1 h) (I + L0 h) F by its entries, in SQL; h is half the step."""
    m = ("(1 - s.tt * s.dt / 2)", "(-s.tp * s.dt / 2)", "(-s.pt * s.dt / 2)", "(1 - s.pp * s.dt / 2)")
    n = ("(1 + r.tt * s.dt / 2)", "(r.tp * s.dt / 2)", "(r.pt * s.dt / 2)", "(1 + r.pp * s.dt / 2)")
    det = f"({m[0]} * {m[3]} - {m[1]} * {m[2]})"
    inv = (f"{m[3]} / {det}", f"-{m[1]} / {det}", f"-{m[2]} / {det}", f"{m[0]} / {det}")
    prod = lambda a, b: (f"({a[0]} * {b[0]} + {a[1]} * {b[2]})", f"({a[0]} * {b[1]} + {a[1]} * {b[3]})", f"({a[2]} * {b[0]} + {a[3]} * {b[2]})", f"({a[2]} * {b[1]} + {a[3]} * {b[3]})")
    f = prod(prod(inv, n), ("r.f0", "r.f1", "r.f2", "r.f3"))
    return ", ".join(f"CASE WHEN abs{det} < 1e-12 THEN r.f{i} ELSE {e} END AS f{i}" for i, e in enumerate(f))


#: Of rows that share an order and line the least counts.
_ONE = _ST.replace("FROM lineitem)", "FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_discount, l_tax) = 1) x)")
ORACLES["strain_accumulate"] = f"WITH RECURSIVE {_ONE}, r AS (SELECT k, i, tt, tp, pt, pp, 1e0 AS f0, 0e0 AS f1, 0e0 AS f2, 1e0 AS f3 FROM steps WHERE i = 1 UNION ALL SELECT s.k, s.i, s.tt, s.tp, s.pt, s.pp, {_advance()} FROM r JOIN steps s ON s.k = r.k AND s.i = r.i + 1) SELECT k AS l_orderkey, {rnd('arg_max(f0, i)')} AS tt, {rnd('arg_max(f3, i)')} AS pp, {rnd('arg_max(abs(f0 * f3 - f1 * f2) - 1, i)')} AS dilatation FROM r GROUP BY k"


@query("thickness_evolution", f"WITH {_ST} SELECT k AS l_orderkey, {rnd('40e0 * product((1 - (tt + pp) * 0.5e0 / 2) / (1 + (tt + pp) * 0.5e0 / 2))')} AS thickness FROM steps GROUP BY k")
def _(spark, d):
    g = gradients(spark, d).select("l_orderkey", "l_linenumber", kinematics.dilatation_rate(F.col("g")).alias("rate"))
    rates = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "rate"))), lambda x: F.struct(F.lit(0.5).alias("dt"), x["rate"].alias("rate")))
    return g.groupBy("l_orderkey").agg(rates.alias("r")).select("l_orderkey", r6(kinematics.evolved_thickness(F.col("r"), F.lit(40.0))).alias("thickness"))


@query("strain_interpolation", "SELECT l_suppkey, round(sum(0.75e0 * (l_quantity - 25) / 100 + 0.25e0), 6) + 0e0 AS tt, round(sum(0.75e0 * l_discount), 6) + 0e0 AS tp FROM lineitem GROUP BY 1")
def _(spark, d):
    mixed = kinematics.interpolated(F.col("g"), kinematics.unit_tensor(), F.lit(0.25))
    return gradients(spark, d).groupBy("l_suppkey").agg(r6(F.sum(mixed["tt"])).alias("tt"), r6(F.sum(mixed["tp"])).alias("tp"))


@query("boundary_smoothing", f"WITH {G}, s AS (SELECT *, least(1e0, {to_arc(D, A, B)} / 0.5e0) AS f FROM g) SELECT id, {', '.join(rnd(f'f * a{c} + (1 - f) * h{c}') + f' AS {c}' for c in 'xyz')} FROM s")
def _(spark, d):
    """Two velocities mixed by the distance of a point to a boundary."""
    mixed = kinematics.smoothed(F.col("a"), F.col("b"), S.point_to_arc(F.col("d"), F.col("a"), F.col("b")), 0.5)
    return triples(spark, d).select("id", *xyz_out(mixed))


# --- folds of half stages ---------------------------------------------------------------------------

_HT = [0.0, 10.0, 20.0, 25.0, 30.0, 40.0, 50.0, 60.0]
_ID = "1e0 AS w, 0e0 AS x, 0e0 AS y, 0e0 AS z"


def _half(prefix: str = "") -> str:
    q = [f"{prefix}{c}" for c in "wxyz"]
    n = f"sqrt({q[1]} * {q[1]} + {q[2]} * {q[2]} + {q[3]} * {q[3]})"
    sg = f"CASE WHEN {q[0]} < 0 THEN -1 ELSE 1 END"
    rest = ", ".join(f"CASE WHEN abs({q[0]}) >= 1 - 1e-12 THEN 0e0 ELSE sin(atan2({n}, abs({q[0]})) / 2) * {sg} * {v} / {n} END AS {c}" for v, c in zip(q[1:], "xyz", strict=True))
    return f"CASE WHEN abs({q[0]}) >= 1 - 1e-12 THEN 1e0 ELSE cos(atan2({n}, abs({q[0]})) / 2) END AS w, {rest}"


ORACLES["half_stage_multi"] = f"""WITH RECURSIVE {rot_sql(_HT)}, {C},
rel AS (SELECT a.time, a.plate_id, {named(mul(conj(quat('b.')), quat('a.')))} FROM rot a JOIN rot b ON b.time = a.time AND b.plate_id = 101),
ends(age, k, t0, t1) AS (VALUES (25e0, 1, 0e0, 10e0), (25e0, 2, 10e0, 20e0), (25e0, 3, 20e0, 25e0), {', '.join(f'(60e0, {k}, {10 * (k - 1)}e0, {10 * k}e0)' for k in range(1, 7))}),
st AS (SELECT age, k, a.plate_id, {named(mul(quat('b.'), conj(quat('a.'))))} FROM ends JOIN rel a ON a.time = t0 JOIN rel b ON b.time = t1 AND b.plate_id = a.plate_id),
hf AS (SELECT age, k, plate_id, {_half()} FROM st),
fold AS (SELECT age, plate_id, k, w, x, y, z FROM hf WHERE k = 1 UNION ALL SELECT h.age, h.plate_id, h.k, {named(mul(quat('h.'), quat('f.')))} FROM fold f JOIN hf h ON h.age = f.age AND h.plate_id = f.plate_id AND h.k = f.k + 1),
last AS (SELECT * FROM fold WHERE (age = 25 AND k = 3) OR (age = 60 AND k = 6)),
al AS (SELECT n.age, n.plate_id, {named(mul(quat('l.'), quat('n.')))} FROM last n JOIN rot l ON l.time = n.age AND l.plate_id = 101)
SELECT cv.id, al.age AS time, {out(turn(quat('al.'), ('cv.x', 'cv.y', 'cv.z')))} FROM cv JOIN al ON al.plate_id = cv.id % 3 + 102 AND al.age = CASE WHEN cv.id % 2 = 0 THEN 25 ELSE 60 END"""


_FT = [0.0, 10.0, 20.0, 40.0, 60.0]
_SIDES2 = "sides(side, fix, mov) AS (VALUES ('left', 101, 103), ('right', 103, 101))"


ORACLES["flowline"] = f"""WITH RECURSIVE {rot_sql(_FT)}, {C}, {_SIDES2},
rel AS (SELECT side, a.time, {named(mul(conj(quat('f.')), quat('a.')))} FROM sides JOIN rot f ON f.plate_id = fix JOIN rot a ON a.plate_id = mov AND a.time = f.time),
ends(k, t0, t1) AS (VALUES {', '.join(f'({k}, {a!r}e0, {b!r}e0)' for k, (a, b) in enumerate(zip(_FT, _FT[1:], strict=False), 1))}),
st AS (SELECT a.side, k, {named(mul(quat('b.'), conj(quat('a.'))))} FROM ends JOIN rel a ON a.time = t0 JOIN rel b ON b.time = t1 AND b.side = a.side),
hf AS (SELECT side, k, {_half()} FROM st),
ln AS (SELECT id, side, 0 AS k, x, y, z FROM cv, sides UNION ALL SELECT n.id, n.side, h.k, {named(turn(quat('h.'), ('n.x', 'n.y', 'n.z')), 'xyz')} FROM ln n JOIN hf h ON h.side = n.side AND h.k = n.k + 1)
SELECT id, side, k AS nth, {XYZ} FROM ln"""


# --- rasters and topologies ---------------------------------------------------------------------------


_PX2 = "px AS (SELECT CAST(o_orderkey % 36 * 5 - 87.5 AS DOUBLE) AS lat, CAST(o_orderkey % 72 * 5 - 177.5 AS DOUBLE) AS lon, o_totalprice AS value, CASE WHEN o_orderkey % 5 = 0 THEN 0e0 ELSE 1e0 END AS coverage FROM orders), pv AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM px WHERE coverage > 0)"


def _raster_sql(km: str) -> str:
    return f"WITH {T}, {_TT}, {_PX2}, j AS (SELECT target_id, value, cos(radians(lat)) AS w FROM tt, pv WHERE {km} < 400e0) SELECT t.target_id AS seed_id, min(value) AS lo, max(value) AS hi, round(sum(w * value) / sum(w), 3) + 0e0 AS mean, count(value) AS pixels FROM t LEFT JOIN j ON j.target_id = t.target_id GROUP BY t.target_id"


def _raster_regions(spark, d, kind: str, fill: bool) -> DataFrame:
    from .catalog import pixels

    seeds = shaped(spark, d, kind).withColumnRenamed("target_id", "seed_id")
    got = raster.region_statistics(seeds, pixels(spark, d), 400.0, fill_polygons=fill)
    return got.select("seed_id", F.col("min").alias("lo"), F.col("max").alias("hi"), (F.round("mean", 3) + F.lit(0.0)).alias("mean"), F.coalesce("pixels", F.lit(0).cast("long")).alias("pixels"))


@query("raster_roi_lines", _raster_sql(_LINE_KM))
def _(spark, d):
    return _raster_regions(spark, d, "polyline", True)


@query("raster_roi_filled_polygons", _raster_sql(_SOLID_KM))
def _(spark, d):
    return _raster_regions(spark, d, "polygon", True)


@query("raster_roi_outlines", _raster_sql(f"least({to_arc(_PP, _TA, _TB)}, {to_arc(_PP, _TB, _TD)}, {to_arc(_PP, _TD, _TA)}) * 6378.137e0"))
def _(spark, d):
    return _raster_regions(spark, d, "polygon", False)


@query("raster_bands_at_time", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 200 >= 60 AND o_orderkey % 50 <= 60")
def _(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("band"), (k % 200).cast("double").alias("begin"), (k % 50).cast("double").alias("end"))
    return raster.band_at(rows, 60.0, "O").select("o_orderkey")


@query("scalar_field_statistics", "WITH f AS (SELECT o_custkey % 50 AS lat, o_custkey % 7 AS lon, o_orderkey AS depth, o_totalprice AS value FROM orders), g AS (SELECT value, (lead(value) OVER w - value) / (lead(depth) OVER w - depth) AS gradient FROM f WINDOW w AS (PARTITION BY lat, lon ORDER BY depth)) SELECT min(value) AS value_min, max(value) AS value_max, round(avg(value), 3) AS value_mean, round(stddev_pop(value), 3) AS value_std_dev, round(min(gradient), 3) AS gradient_min, round(max(gradient), 3) AS gradient_max, round(avg(gradient), 3) AS gradient_mean, round(stddev_pop(gradient), 3) AS gradient_std_dev FROM g")
def _(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("lat"), (F.col("o_custkey") % 7).alias("lon"), F.col("o_orderkey").alias("depth"), F.col("o_totalprice").alias("value"))
    s = raster.scalar_field_summary(rows)
    return s.select("value_min", "value_max", *(F.round(c, 3).alias(c) for c in ("value_mean", "value_std_dev", "gradient_min", "gradient_max", "gradient_mean", "gradient_std_dev")))


@query("area_sampling", f"WITH {C}, b AS (SELECT id, floor((lat + 90) / 20) AS r, lon FROM c), w AS (SELECT *, floor((lon + 180) / (20 / greatest(cos(radians((r + 0.5) * 20 - 90)), 0.01e0))) AS q FROM b) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY r, q ORDER BY id) AS n FROM w) x WHERE n <= 3")
def _(spark, d):
    return raster.area_sample(customers(spark, d), 20.0, 3, "id").select("id")


@query("sections_referenced", "SELECT DISTINCT l_partkey % 50 AS feature_id FROM lineitem")
def _(spark, d):
    return topology.referenced(table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("feature_id")))


_BAR = f"{_TRI}, bc AS (SELECT *, {', '.join(f'0.5e0 * a{c} + 0.3e0 * h{c} + 0.2e0 * d{c} AS p{c}' for c in 'xyz')} FROM tri), bn AS (SELECT *, {', '.join(f'p{c} / {norm(vec(chr(112)))} AS u{c}' for c in 'xyz')} FROM bc)"


@query("barycentric_weights", f"WITH {_BAR}, w AS (SELECT id, {area(vec('u'), B, D)} / {area(A, B, D)} AS a, {area(A, vec('u'), D)} / {area(A, B, D)} AS b FROM bn) SELECT id, round(a, 5) AS a, round(b, 5) AS b, round(1 - a - b, 5) AS c FROM w")
def _(spark, d):
    a, b, c = (F.element_at(F.element_at("rings", 1), i) for i in (1, 2, 3))
    p = S.normalise(S.add(S.add(S.scale(a, F.lit(0.5)), S.scale(b, F.lit(0.3))), S.scale(c, F.lit(0.2))))
    rows = triangles(spark, d).select("id", p.alias("p"), a.alias("a"), b.alias("b"), c.alias("c"))
    w = topology.barycentric(F.col("p"), F.col("a"), F.col("b"), F.col("c"))
    return rows.select("id", w.alias("w")).select("id", *(F.round(f"w.{x}", 5).alias(x) for x in "abc"))


_BOX = [((-5, -8), (-5, 0), (-5, 8)), ((-8, 5), (0, 5), (8, 5)), ((5, 8), (5, 0), (5, -8)), ((8, -5), (0, -5), (-8, -5))]


def _box_sql(shown=rnd) -> str:
    """Corners and middles of the four lines' ring, in order, and its area."""
    at = {}
    cols = []
    for i, line in enumerate(_BOX):
        for j, (la, lo) in enumerate(line):
            cols.append(xyz(f"lat + {la}", f"lon + {lo}", f"s{i}{j}"))
            at[i, j] = vec(f"s{i}{j}")
    corner = lambda i: cr(cr(at[i, 1], at[i, 2]), cr(at[(i + 1) % 4, 0], at[(i + 1) % 4, 1]))
    raw = ", ".join(f"{e} AS r{i}{c}" for i in range(4) for e, c in zip(corner(i), "xyz", strict=True))
    unit = ", ".join(f"r{i}{c} / {norm(vec(f'r{i}'))} * CASE WHEN {dt(vec(f'r{i}'), at[i, 1])} > 0 THEN 1 ELSE -1 END AS c{i}{c}" for i in range(4) for c in "xyz")
    ring = [p for i in range(4) for p in (at[i, 1], vec(f"c{i}"))]
    mid = tuple("(" + " + ".join(p[k] for p in ring) + ")" for k in range(3))
    total = " + ".join(area(vec("m"), ring[k], ring[(k + 1) % 8]) for k in range(8))
    middle = ", ".join(f"{e} / {norm(mid)} AS m{c}" for e, c in zip(mid, "xyz", strict=True))  # type: ignore[arg-type]
    return f"n AS (SELECT CAST(n_nationkey AS BIGINT) AS topology_id, CAST(n_nationkey * 5 - 60 AS DOUBLE) AS lat, CAST(n_nationkey * 13 - 150 AS DOUBLE) AS lon FROM nation), p AS (SELECT *, {', '.join(cols)} FROM n), x AS (SELECT *, {raw} FROM p), u AS (SELECT *, {unit} FROM x), v AS (SELECT *, {middle} FROM u) SELECT topology_id, 8 AS points, {shown(f'abs({total})')} AS area FROM v"


ORACLES["topology_boundaries"] = f"WITH {_box_sql()}"


@query("shared_sub_segments", """WITH p AS (SELECT DISTINCT l_partkey % 50 AS feature_id, l_suppkey % 20 AS topology_id, CAST(l_quantity AS DOUBLE) AS lo, CAST(l_quantity + 1 + l_linenumber % 3 AS DOUBLE) AS hi FROM lineitem),
e AS (SELECT feature_id, lo AS pt FROM p UNION SELECT feature_id, hi FROM p),
s AS (SELECT feature_id, pt AS lo, lead(pt) OVER (PARTITION BY feature_id ORDER BY pt) AS hi FROM e)
SELECT s.feature_id, s.lo, s.hi, count(DISTINCT topology_id) AS topologies FROM s JOIN p ON p.feature_id = s.feature_id AND p.lo <= s.lo AND p.hi >= s.hi GROUP BY 1, 2, 3""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit(0.0).alias("time"), (F.col("l_partkey") % 50).alias("feature_id"), (F.col("l_suppkey") % 20).alias("topology_id"), F.col("l_quantity").cast("double").alias("lo"), (F.col("l_quantity") + 1 + F.col("l_linenumber") % 3).cast("double").alias("hi"), F.lit(False).alias("reverse")).distinct()
    return topology.shared_sub_segments(rows).select("feature_id", "lo", "hi", F.size("topologies").cast("long").alias("topologies"))


_STEP = f"hh AS (SELECT *, {_OCT_ID} AS hit FROM cv), sg AS (SELECT a.plate_id, {named(mul(quat('b.'), conj(quat('a.'))))} FROM rot a JOIN rot b ON b.plate_id = a.plate_id WHERE a.time = 60 AND b.time = 50), mv AS (SELECT hh.id, hh.hit, hh.x AS vx, hh.y AS vy, hh.z AS vz, coalesce(q.w, 1e0) AS w, coalesce(q.x, 0e0) AS x, coalesce(q.y, 0e0) AS y, coalesce(q.z, 0e0) AS z FROM hh LEFT JOIN sg q ON q.plate_id = hh.hit)"


@query("topology_reconstruction_step", f"WITH RECURSIVE {rot_sql([50.0, 60.0])}, {C}, {_STEP} SELECT id, CAST(hit AS BIGINT) AS plate_id, {out(turn(('w', 'x', 'y', 'z'), vec('v')))} FROM mv")
def _(spark, d):
    """Points carried from 60 to 50 by the octants that hold them."""
    surfaces = octants(spark).withColumn("time", F.lit(60.0))
    span = evolution.reconstruct_by_topologies(customers(spark, d).select("id", "v"), surfaces, R.rotations(samples(spark, d), [60.0, 50.0]), [60.0, 50.0])
    return span.where("time = 50").select("id", "plate_id", *xyz_out(F.col("v")))


@query("scalar_coverage_span", f"WITH {_ONE}, f AS (SELECT k, n, 40e0 * product(CASE WHEN n > 1 THEN (1 - (tt + pp) / 2) / (1 + (tt + pp) / 2) ELSE 1e0 END) OVER (PARTITION BY k ORDER BY n) AS value FROM steps) SELECT k AS id, CAST(100 - n AS DOUBLE) AS time, round(value, 5) + 0e0 AS value FROM f")
def _(spark, d):
    """Thickness at each line of an order, a line a million years."""
    g = gradients(spark, d).groupBy("l_orderkey", "l_linenumber").agg(F.min("g").alias("g"))
    rates = g.select(F.col("l_orderkey").alias("id"), (100.0 - F.col("l_linenumber")).alias("time"), kinematics.dilatation_rate(F.col("g")).alias("rate"), F.lit(True).alias("active"))
    initial = g.select(F.col("l_orderkey").alias("id"), F.lit(40.0).alias("value")).distinct()
    times = [99.0 - i for i in range(60)]
    return evolution.scalar_span(rates, initial, times).select("id", "time", (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query("feature_kinds", "SELECT count(*) FILTER (WHERE c_custkey % 4 = 0) AS networks, count(*) FILTER (WHERE c_custkey % 4 = 1) AS lines, count(*) FILTER (WHERE c_custkey % 4 < 2) AS topologies, count(*) FILTER (WHERE c_custkey % 3 = 0) AS points, count(*) FILTER (WHERE c_custkey % 5 > 0 AND c_custkey % 7 > 0) AS rotations FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    named_ = F.when(k % 4 == 0, "TopologicalNetwork").when(k % 4 == 1, "TopologicalLine").when(k % 4 == 2, "Coastline")
    rows = table(spark, d, "customer").select(named_.alias("feature_type"), F.when(k % 3 == 0, "point").when(k % 3 == 1, "polygon").alias("gtype"), F.when(k % 5 > 0, k).alias("fixed"), F.when(k % 7 > 0, k).alias("moving"), F.array(k).alias("samples"))
    rows = rows.withColumn("topology_kind", predicates.topology_kind())
    n = lambda c: F.sum(c.cast("long"))
    return rows.agg(n(predicates.is_topology("network")).alias("networks"), n(predicates.is_type("TopologicalLine")).alias("lines"), n(predicates.is_topology()).alias("topologies"), n(predicates.has_geometry("point")).alias("points"), n(predicates.is_rotation()).alias("rotations"))


# --- rotations, valid times, rasters and streams again ------------------------------------------------


def _slerp(a: tuple[str, ...], b: tuple[str, ...], t: str) -> tuple[str, ...]:
    d = "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b, strict=True)) + ")"
    w = f"acos(least(1e0, abs{d}))"
    return tuple(f"CASE WHEN abs{d} >= 1 - 1e-12 THEN {p} ELSE (sin((1 - {t}) * {w}) * {p} + CASE WHEN {d} < 0 THEN -1 ELSE 1 END * sin({t} * {w}) * {q}) / sin({w}) END" for p, q in zip(a, b, strict=True))


def _axis(v: Vec, degrees: str, prefix: str) -> str:
    return f"cos(radians({degrees}) / 2) AS {prefix}w, " + ", ".join(f"sin(radians({degrees}) / 2) * {e} AS {prefix}{c}" for e, c in zip(v, "xyz", strict=True))


_Q3 = f"q AS (SELECT id, {_axis(A, '30e0', 'p')}, {_axis(B, '50e0', 'q')}, {_axis(D, '70e0', 'r')} FROM g), pq AS (SELECT *, {', '.join(f'{e} AS m{c}' for e, c in zip(_slerp(quat('p'), quat('q'), '0.6e0'), 'wxyz', strict=True))} FROM q)"


@query("three_way_interpolation", f"WITH {G}, {_Q3} SELECT id, {', '.join(f'{rnd(e)} AS {c}' for e, c in zip(_slerp(quat('m'), quat('r'), '0.5e0'), 'wxyz', strict=True))} FROM pq")
def _(spark, d):
    """Three rotations by weights of 0.2, 0.3 and 0.5."""
    q = [Q.from_axis(F.col(v), F.radians(F.lit(t))) for v, t in (("a", 30.0), ("b", 50.0), ("d", 70.0))]
    rows = triples(spark, d).select("id", *(x.alias(n) for x, n in zip(q, "pqr", strict=True)))
    mixed = Q.slerp3(F.col("p"), F.col("q"), F.col("r"), F.lit(0.2), F.lit(0.3), F.lit(0.5))
    return rows.select("id", mixed.alias("m")).select("id", *q_out(F.col("m")))


@query("times_without_valid_time", "SELECT time, count(*) AS features FROM customer, (VALUES (0e0), (60e0)) t(time) GROUP BY 1")
def _(spark, d):
    t = spark.createDataFrame([(0.0,), (60.0,)], "time double")
    return reconstruct.at_times(customers(spark, d), t, ignore_valid_time=True).groupBy("time").agg(F.count("*").alias("features"))


@query("samples_switched_off", f"WITH RECURSIVE {rot_sql([20.0, 60.0])} SELECT CAST(seq AS BIGINT) AS seq, time, {', '.join(f'{rnd(c)} AS {c}' for c in 'wxyz')} FROM e")
def _(spark, d):
    """Samples that are switched off change nothing."""
    off = samples(spark, d).withColumns({"disabled": F.lit(True), "time": F.col("time") + 7.0, "angle": F.col("angle") + 50.0})
    t = spark.createDataFrame([(20.0,), (60.0,)], "time double")
    return R.bracket(R.usable(samples(spark, d).unionByName(off)), t).select("seq", "time", *(r6(F.col(f"q.{c}")).alias(c) for c in "wxyz"))


_PQ = f"pq AS (SELECT value, CAST(o_orderkey % 36 * 5 - 87.5 AS DOUBLE) AS lat, CAST(o_orderkey % 72 * 5 - 177.5 AS DOUBLE) AS lon FROM (SELECT *, o_totalprice AS value FROM orders) o), pv AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM pq), ph AS (SELECT *, {_OCT_ID} AS hit FROM pv), pm AS (SELECT value, {named(turn(tuple(f'coalesce(r.{c}, {v})' for c, v in zip('wxyz', ('1e0', '0e0', '0e0', '0e0'), strict=True)), ('ph.x', 'ph.y', 'ph.z')), 'xyz')} FROM ph LEFT JOIN rot r ON r.plate_id = hit)"


@query("reconstructed_raster", f"WITH RECURSIVE {rot_sql([20.0])}, {_PQ} SELECT CAST(floor({latlon()[0]} / 5) AS BIGINT) AS row, CAST(floor({latlon()[1]} / 5) AS BIGINT) AS col, round(avg(value), 7) + 0e0 AS value FROM pm GROUP BY 1, 2")
def _(spark, d):
    """Orders as pixels, moved with the octants to 20 and put on a grid of 5 degrees."""
    from .catalog import pixels

    px = pixels(spark, d)
    got = raster.reconstructed(px, octants(spark), R.rotations(samples(spark, d), [20.0]), 20.0, 5.0)
    # sums of cents over few pixels: more digits than these are noise, fewer are ties
    return got.select("row", "col", (F.round("value", 7) + F.lit(0.0)).alias("value"))


@query("net_rotation_areas", f"WITH {C} SELECT plate_id, round(sum(sqrt(1 - z * z)) * 510000000 / 41252, 3) + 0e0 AS area_km2 FROM cv WHERE plate_id <= 105 GROUP BY 1")
def _(spark, d):
    from .catalog import _net

    return _net(spark, d).select("plate_id", (F.round("area_km2", 3) + F.lit(0.0)).alias("area_km2"))


@query("stream_counts", "SELECT date_trunc('hour', ts) AS from_, user_id % 5 AS plate_id, count(*) AS points FROM events GROUP BY 1, 2")
def _(spark, d):
    """The windowed counts that streams give, over a table."""
    from . import streaming

    rows = table(spark, d, "events").select("ts", (F.col("user_id") % 5).alias("plate_id"))
    return streaming.counts_by_plate(rows, "ts", "1 hour", "1 day").select(F.col("window.start").alias("from_"), "plate_id", "points")


@query("partitioned_valid_time", f"WITH {C} SELECT id, CASE WHEN begin_ >= 60 AND end_ <= 60 THEN CAST({_OCT_ID} AS BIGINT) ELSE plate_id END AS plate_id, CASE WHEN begin_ >= 60 AND end_ <= 60 THEN 200e0 + CAST({_OCT_ID} AS BIGINT) % 8 ELSE begin_ END AS begin FROM cv")
def _(spark, d):
    """Points alive at 60 take the plate and the begin of their octant."""
    rows = customers(spark, d).select("id", "plate_id", "begin", "end", F.lit(60.0).alias("time"), F.lit("point").alias("gtype"), F.array(F.array("v")).alias("rings"))
    polygons = octants(spark).withColumn("begin", 200.0 + F.col("plate_id") % 8)
    return partition.partition_features(rows, polygons, take=("plate_id", "begin")).select("id", "plate_id", "begin")


@query("rejected_configurations", "SELECT * FROM (VALUES ('percentile', TRUE), ('weighted_mean', TRUE), ('min_distance', TRUE), ('presence', TRUE), ('min', FALSE)) t(reducer, rejected)")
def _(spark, d):
    """Reducers without a defined result are refused before any work."""

    def rejected(name: str) -> bool:
        try:
            coregistration.check_config([coregistration.Column_("t", "x", name, 10.0)])
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(n, rejected(n)) for n in ("percentile", "weighted_mean", "min_distance", "presence", "min")], "reducer string, rejected boolean")
