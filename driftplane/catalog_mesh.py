"""Registered queries over networks and over geometries that move through topologies, with SQL
that works their results out from plain formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _OCT_ID, C, customers, named, octants, query, quat, mul, conj, r6, rnd, rot_sql, samples, table, turn
from .catalog_more import _BOX, _TRI, _box_sql, ang, area, cr, dt, norm, to_arc, triangles, vec, xyz
from .functions import sphere as S
from .functions import quaternion as Q
from .operators import evolution, hellinger, kinematics, mesh, partition, shared, topology
from .operators import rotation_model as R

#: A nation's middle in degrees; orders and customers lie about it.
_N = "n AS (SELECT CAST(n_nationkey AS BIGINT) AS topology_id, CAST(n_nationkey * 5 - 60 AS DOUBLE) AS lat, CAST(n_nationkey * 13 - 150 AS DOUBLE) AS lon FROM nation)"


def nations(spark, d) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return table(spark, d, "nation").select(n.alias("topology_id"), (n * 5 - 60).cast("double").alias("lat"), (n * 13 - 150).cast("double").alias("lon"))


def _at(la, lo):
    return S.from_lat_lon(F.col("lat") + la, F.col("lon") + lo)


def _sections(spark, d) -> DataFrame:
    """Four lines about each nation that cross at the corners of a box."""
    out = None
    for i, line in enumerate(_BOX):
        one = nations(spark, d).select("topology_id", F.lit(i).alias("section_index"), (F.col("topology_id") * 4 + i).alias("feature_id"), F.array(*(_at(*p) for p in line)).alias("line"))
        out = one if out is None else out.unionByName(one)
    return out.withColumns({"time": F.lit(0.0), "reverse": F.lit(False), "is_interior": F.lit(False), "is_block": F.lit(False)})


def _inner(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"time": F.lit(0.0), "reverse": F.lit(False), "is_interior": F.lit(True)})


def _orders(spark, d) -> DataFrame:
    """A point an order, near the middle of its nation."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select((k % 25).alias("topology_id"), k.alias("id"), (k * 53 % 997 * 0.002 - 1).alias("dla"), (k * 71 % 991 * 0.001 - 0.5).alias("dlo"))
    return o.join(nations(spark, d), "topology_id").withColumn("v", _at(F.col("dla"), F.col("dlo")))




def _size():
    return F.abs(S.triangle_area(*(F.element_at("vertices", i) for i in (1, 2, 3))))


_COUNTS = "o AS (SELECT o_orderkey % 25 AS topology_id, count(DISTINCT (o_orderkey * 53 % 997, o_orderkey * 71 % 991)) AS inner_ FROM orders GROUP BY 1)"


@query("network_faces", f"WITH {_COUNTS}, {_box_sql().replace('SELECT topology_id, 8 AS points', 'SELECT v.topology_id, 2 * coalesce(inner_, 0) + 8 - 2 AS faces')} LEFT JOIN o ON o.topology_id = v.topology_id")
def _(spark, d):
    """Every nation's orders triangulated within a boundary of eight corners: Euler's number of
    faces, and the boundary's area."""
    points = _orders(spark, d).select("topology_id", F.lit(9).alias("section_index"), (F.col("id") + 1000).alias("feature_id"), F.array("v").alias("line"), F.lit(False).alias("is_block"))
    faces = topology.networks(_sections(spark, d).unionByName(_inner(points)))
    return faces.groupBy("topology_id").agg(F.count("*").alias("faces"), r6(F.sum(_size())).alias("area"))


_BLOCK = [(-1.5, -1.5), (-1.5, 1.5), (1.5, 1.5), (1.5, -1.5)]


def _quad_sql(corners: list[tuple[float, float]], prefix: str) -> tuple[str, list]:
    return ", ".join(xyz(f"lat + {la}", f"lon + {lo}", f"{prefix}{i}") for i, (la, lo) in enumerate(corners)), [vec(f"{prefix}{i}") for i in range(len(corners))]


_QB, _QV = _quad_sql(_BLOCK, "b")
_BLOCK_AREA = f"abs({area(_QV[0], _QV[1], _QV[2])} + {area(_QV[0], _QV[2], _QV[3])})"


@query("network_rigid_blocks", f"WITH box AS (WITH {_box_sql(str)}), bc AS (SELECT topology_id, {_QB} FROM ({_N[6:-1]}) n), ba AS (SELECT topology_id, {_BLOCK_AREA} AS block FROM bc) SELECT topology_id, 'rigid' AS region, round(block, 5) AS area FROM ba UNION ALL SELECT topology_id, 'deforming', round(area - block, 5) FROM box JOIN ba USING (topology_id)")
def _(spark, d):
    """A rigid block in each network, whose edges and the boundary's are edges of faces."""
    k = F.col("c_custkey")
    spots = table(spark, d, "customer").select((k % 25).alias("topology_id"), k.alias("id"), (k * 53 % 997 * 0.008 - 4).alias("dla"), (k * 71 % 991 * 0.008 - 4).alias("dlo")).join(nations(spark, d), "topology_id")
    points = spots.select("topology_id", F.lit(9).alias("section_index"), (F.col("id") + 1000).alias("feature_id"), F.array(_at(F.col("dla"), F.col("dlo"))).alias("line"), F.lit(False).alias("is_block"))
    blocks = nations(spark, d).select("topology_id", F.lit(10).alias("section_index"), (-1 - F.col("topology_id")).alias("feature_id"), F.array(*(_at(*p) for p in _BLOCK)).alias("line"), F.lit(True).alias("is_block"))
    faces = topology.networks(_sections(spark, d).unionByName(_inner(points.unionByName(blocks))), forced=True)
    return faces.groupBy("topology_id", "region").agg((F.round(F.sum(_size()), 5) + F.lit(0.0)).alias("area"))


_WIDE = [(-10.5, -6.5), (-10.5, 6.5), (10.5, 6.5), (10.5, -6.5)]
_QW, _WV = _quad_sql([(float(a), float(b)) for a, b in _WIDE], "w")


def _within(ring: list, v=("x", "y", "z")) -> str:
    """Inside a convex outline that runs anticlockwise."""
    return " AND ".join(f"{dt(cr(ring[i], ring[(i + 1) % len(ring)]), v)} > 0" for i in range(len(ring)))


@query("network_regions", f"WITH {C}, {_N}, g AS (SELECT *, {_QW}, {_QB} FROM n), net AS (SELECT id, min(topology_id) AS topology_id FROM cv JOIN g ON {_within(_WV)} GROUP BY id), blk AS (SELECT id, topology_id FROM cv JOIN g ON {_within(_QV)}) SELECT cv.id, net.topology_id, CASE WHEN net.id IS NULL THEN 'outside' WHEN blk.id IS NOT NULL THEN 'rigid' ELSE 'deforming' END AS region FROM cv LEFT JOIN net ON net.id = cv.id LEFT JOIN blk ON blk.id = net.id AND blk.topology_id = net.topology_id")
def _(spark, d):
    """Customers in the first of overlapping networks, in its rigid block, or outside."""
    n = nations(spark, d)
    outlines = n.select("topology_id", F.array(*(_at(*p) for p in _WIDE)).alias("ring"))
    blocks = n.select("topology_id", F.lit("b").alias("block"), F.array(*(_at(*p) for p in _BLOCK)).alias("ring"))
    return topology.locate(customers(spark, d).select("id", "v"), outlines, blocks).select("id", "topology_id", "region")


@query("polygon_area", f"WITH {_N}, g AS (SELECT *, {_QW}, {_QB} FROM n) SELECT topology_id, {rnd(f'abs({area(_WV[0], _WV[1], _WV[2])} + {area(_WV[0], _WV[2], _WV[3])}) - {_BLOCK_AREA}')} AS area FROM g")
def _(spark, d):
    """A box about each nation, less a hole."""
    rings = F.array(*(F.array(*(_at(*p) for p in r)) for r in (_WIDE, _BLOCK)))
    return nations(spark, d).select("topology_id", r6(S.polygon_area(rings)).alias("area"))


_MID = ", ".join(f"(a{c} + h{c} + d{c}) / {norm(tuple(f'(a{k} + h{k} + d{k})' for k in 'xyz'))} AS {c}" for c in "xyz")  # type: ignore[arg-type]
_HOLDS = " AND ".join(f"s * {dt(cr(vec(p), vec(q)), ('m.x', 'm.y', 'm.z'))} > 0" for p, q in (("a", "h"), ("h", "d"), ("d", "a")))


@query("network_locations", f"WITH {_TRI}, m AS (SELECT id AS point, {_MID} FROM tri) SELECT m.point AS id, tri.id AS topology_id FROM m JOIN tri ON {_HOLDS}")
def _(spark, d):
    """The middle of every triangle, in all the triangles that hold it."""
    tri = triangles(spark, d)
    corner = [F.col("rings")[0][i] for i in range(3)]
    points = tri.select("id", S.normalise(S.add(S.add(corner[0], corner[1]), corner[2])).alias("v"))
    faces = tri.select(F.col("id").alias("plate_id"), "rings", F.struct("id").alias("priority"))
    return partition.hits(points, faces, copies=True).select("id", F.col("hit").alias("topology_id"))


def _mesh(spark, d) -> DataFrame:
    """Faces of each nation's orders, in the plane about the nation."""
    o = _orders(spark, d).withColumn("centre", S.from_lat_lon("lat", "lon")).withColumn("p", mesh.in_plane(F.col("v"), F.col("centre")))
    points = o.select(F.lit(0.0).alias("time"), "topology_id", "v.x", "v.y", "v.z", "p.u", "p.w")
    corners = F.array(*(F.struct(*(F.col(f"{k}{i}").alias(k) for k in "xyz")) for i in range(3)))
    centres = nations(spark, d).select("topology_id", S.from_lat_lon("lat", "lon").alias("centre"))
    return shared.settled(mesh.triangulated(points).select("topology_id", corners.alias("vertices")).join(centres, "topology_id"))


def _probes(spark, d) -> DataFrame:
    """A point a customer, within the orders of its nation."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select((k % 25).alias("topology_id"), k.alias("id"), (k * 37 % 89 * 0.01 - 0.44).alias("dla"), (k * 29 % 97 * 0.004 - 0.19).alias("dlo"))
    return c.join(nations(spark, d), "topology_id").select("topology_id", "id", _at(F.col("dla"), F.col("dlo")).alias("v"))


_PROBE = "pr AS (SELECT c_custkey AS id, c_custkey % 25 AS topology_id, n_nationkey * 5 - 60 + (c_custkey * 37 % 89) * 0.01e0 - 0.44e0 AS la, n_nationkey * 13 - 150 + (c_custkey * 29 % 97) * 0.004e0 - 0.19e0 AS lo, CAST(n_nationkey * 5 - 60 AS DOUBLE) AS clat, CAST(n_nationkey * 13 - 150 AS DOUBLE) AS clon FROM customer JOIN nation ON n_nationkey = c_custkey % 25)"
_K = "sqrt(2 / (1 + sin(radians(clat)) * sin(radians(la)) + cos(radians(clat)) * cos(radians(la)) * cos(radians(lo - clon))))"


@query("natural_neighbour_coordinates", f"WITH {_PROBE} SELECT id, 1e0 AS weight, round({_K} * cos(radians(la)) * sin(radians(lo - clon)), 5) + 0e0 AS u, round({_K} * (cos(radians(clat)) * sin(radians(la)) - sin(radians(clat)) * cos(radians(la)) * cos(radians(lo - clon))), 5) + 0e0 AS w FROM pr")
def _(spark, d):
    """Natural-neighbour weights give each point as the mean of its neighbours, in the plane."""
    faces = _mesh(spark, d)
    rows = mesh.natural_rows(_probes(spark, d), faces).join(F.broadcast(nations(spark, d)), "topology_id")
    p = mesh.in_plane(F.col("vertex"), S.from_lat_lon("lat", "lon"))
    rows = rows.withColumn("p", p)
    mean = lambda c: (F.round(F.sum(F.col("w") * F.col(f"p.{c}")), 5) + F.lit(0.0)).alias(c)
    return rows.groupBy("id").agg(r6(F.sum("w")).alias("weight"), mean("u"), mean("w"))


@query("strain_at_points", f"WITH {_PROBE} SELECT id, CAST(topology_id AS DOUBLE) AS tt, CAST(2 * topology_id AS DOUBLE) AS pp FROM pr")
def _(spark, d):
    """Smoothed strain rates of points in networks that stretch evenly."""
    t = F.col("topology_id").cast("double")
    faces = _mesh(spark, d).withColumn("face", F.xxhash64("vertices")).withColumn("g", kinematics.tensor(t, F.lit(0.0), F.lit(0.0), 2 * t))
    got = topology.strain_at(_probes(spark, d).select("id", "v"), faces)
    return got.select("id", r6(F.col("g.tt")).alias("tt"), r6(F.col("g.pp")).alias("pp"))


# --- evolution ----------------------------------------------------------------------------------

_STEPS = [60.0, 50.0, 40.0, 70.0]


def _turned(q: str, v) -> str:
    return named(turn(quat(q), v), "xyz")


def _fast(q: str, v) -> tuple[str, str, str]:
    """Velocity in cm/yr under a stage of ten million years, in SQL."""
    n = f"sqrt({q}x * {q}x + {q}y * {q}y + {q}z * {q}z)"
    sg = f"(CASE WHEN {q}w < 0 THEN -1 ELSE 1 END)"
    k = f"(CASE WHEN {n} < 1e-14 THEN 0e0 ELSE {sg} * 2 * atan2({n}, abs({q}w)) / {n} / 10 * 6378.137e0 * 0.1e0 END)"
    axis = (f"{q}x", f"{q}y", f"{q}z")
    return tuple(f"({k} * {e})" for e in cr(axis, v))  # type: ignore[return-value]


_CORNERS = [("(CASE WHEN old < 104 THEN 1e0 ELSE -1e0 END)", "0e0", "0e0"), ("0e0", "(CASE WHEN old % 4 < 2 THEN 1e0 ELSE -1e0 END)", "0e0"), ("0e0", "0e0", "(CASE WHEN old % 2 = 0 THEN 1e0 ELSE -1e0 END)")]
_V = ("x", "y", "z")
_FAR = "least(" + ", ".join(to_arc(_V, _CORNERS[i], _CORNERS[(i + 1) % 3]) for i in range(3)) + ")"
_CHANGE = tuple(f"({a} - {b})" for a, b in zip(_fast("n", _V), _fast("o", _V), strict=True))
_STAGE = lambda a, b: f"SELECT plate_id, {named(mul(quat('b.'), conj(quat('a.'))))} FROM rot a JOIN rot b USING (plate_id) WHERE a.time = {a} AND b.time = {b}"
_ONE = ", ".join(f"coalesce({{0}}.{c}, {v}) AS {{1}}{c}" for c, v in zip("wxyz", ("1e0", "0e0", "0e0", "0e0"), strict=True))
_LINES = f"""ends AS (SELECT id, 0 AS nth, {xyz('lat', 'lon', '')} FROM c UNION ALL SELECT id, 1, {xyz('lat', 'lon + 3', '')} FROM c),
s1 AS ({_STAGE(60, 50)}), s2 AS ({_STAGE(50, 40)}), s0 AS ({_STAGE(60, 70)}),
h1 AS (SELECT *, CAST({_OCT_ID} AS BIGINT) AS old FROM ends),
j1 AS (SELECT h1.id, nth, old, h1.x AS vx, h1.y AS vy, h1.z AS vz, {_ONE.format('s', '')} FROM h1 LEFT JOIN s1 s ON s.plate_id = old),
m1 AS (SELECT id, nth, old, {_turned('', vec('v'))} FROM j1),
h2 AS (SELECT *, CAST({_OCT_ID} AS BIGINT) AS now FROM m1),
j2 AS (SELECT h2.*, {_ONE.format('a', 'n')}, {_ONE.format('b', 'o')} FROM h2 LEFT JOIN s2 a ON a.plate_id = now LEFT JOIN s2 b ON b.plate_id = old),
k2 AS (SELECT *, {norm(_CHANGE)} AS change, {_FAR} AS far FROM j2),
l2 AS (SELECT *, NOT (old <> now AND change > 0.7e0 AND far < (10 + 10 * change) * 10 / 6378.137e0) AS live FROM k2),
young AS (SELECT id, nth, {_turned('n', _V)} FROM l2 WHERE live),
j0 AS (SELECT h1.id, nth, h1.x AS vx, h1.y AS vy, h1.z AS vz, {_ONE.format('s', '')} FROM h1 LEFT JOIN s0 s ON s.plate_id = old),
old_ AS (SELECT id, nth, {_turned('', vec('v'))} FROM j0),
ends_ AS (SELECT 40e0 AS time, * FROM young UNION ALL SELECT 70e0, * FROM old_)"""
_CHORD = "sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2))"


@query("evolved_lines", f"WITH RECURSIVE {rot_sql(_STEPS)}, {C}, {_LINES} SELECT id, time, CASE WHEN count(*) = 2 THEN 'polyline' ELSE 'point' END AS gtype, round({_CHORD}, 5) + 0e0 AS chord FROM ends_ GROUP BY id, time")
def _(spark, d):
    """A line a customer, stepped from 60 to 40 and to 70 by the octants that hold its ends, which
    go where they change octants near an outline with another velocity."""
    lines = customers(spark, d).select("id", F.lit("polyline").alias("gtype"), F.array(F.array("v", S.from_lat_lon(F.col("lat"), F.col("lon") + 3))).alias("rings"))
    times = spark.createDataFrame([(t,) for t in _STEPS], "time double")
    span = evolution.evolve(lines, octants(spark).crossJoin(times), R.rotations(samples(spark, d), _STEPS), _STEPS, 60.0, spacing=1.0)
    got = evolution.reassembled(span.where("time in (40, 70)"))
    a, b = F.element_at("line", 1), F.element_at("line", -1)
    chord = F.sqrt(sum((a[c] - b[c]) * (a[c] - b[c]) for c in "xyz"))
    return got.select("id", "time", "gtype", (F.round(chord, 5) + F.lit(0.0)).alias("chord"))


# --- pole fits ----------------------------------------------------------------------------------

#: Rotations of a key to the first plate: these plus the key in each of the three numbers.
_TRUE = {2: (40.0, -30.0, 12.0), 3: (-20.0, 60.0, 25.0)}


def _picks(spark, d) -> DataFrame:
    """Every order as a pick on one of 24 circles a key, seen from one of the circle's two plates,
    which rotations that go with the key bring together."""
    k = F.col("o_orderkey")
    seg = F.floor(k / 5) % 24
    rows = table(spark, d, "orders").select((k % 5).alias("key"), seg.alias("segment"), (F.floor(k / 120) % 2).alias("side"), (k * 37 % 61).cast("double").alias("along"))
    sides = F.when(F.col("segment") % 3 == 0, F.array(F.lit(1), F.lit(2))).when(F.col("segment") % 3 == 1, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(2), F.lit(3)))
    rows = rows.withColumn("plate", F.element_at(sides, (F.col("side") + 1).cast("int")))
    start = S.from_lat_lon((F.col("segment") * 5 - 60).cast("double"), (F.col("segment") * 47 % 360).cast("double"))
    rows = rows.withColumn("x", S.destination(start, F.radians((F.col("segment") * 71 % 360).cast("double")), F.radians("along")))
    by = lambda p: Q.rotate(Q.conjugate(Q.from_pole(*(F.lit(c) + F.col("key") for c in _TRUE[p]))), F.col("x"))
    rows = rows.withColumn("v", F.when(F.col("plate") == 2, by(2)).when(F.col("plate") == 3, by(3)).otherwise(F.col("x")))
    return rows.select("key", "segment", "plate", S.lat(F.col("v")).alias("lat"), S.lon(F.col("v")).alias("lon"), F.lit(0.01).alias("sigma"))


_POLES = " UNION ALL ".join(f"SELECT key, {p} AS moving, {la!r}e0 + key AS lat, {lo!r}e0 + key AS lon, {an!r}e0 + key AS angle, picks FROM k" for p, (la, lo, an) in _TRUE.items())


@query("fitted_poles", f"WITH k AS (SELECT o_orderkey % 5 AS key, count(*) AS picks FROM orders GROUP BY 1) {_POLES}")
def _(spark, d):
    """Two rotations a key, fitted together over the picks of three plates."""
    found = hellinger.fit_circuits(_picks(spark, d), {p: (la + 3, lo + 1, an + 1) for p, (la, lo, an) in _TRUE.items()})
    shown = [(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("lat", "lon", "angle")]
    return found.where("fixed = 1").select("key", "moving", *shown, "picks")


@query("pole_scatter", "SELECT o_orderkey % 5 AS key, o_orderkey // 5 % 24 AS segment, count(*) AS picks, round(count(*) / 0.0001e0, 0) AS trace FROM orders GROUP BY 1, 2")
def _(spark, d):
    """The sums that fits are made from: their trace is the picks' weight."""
    sums = hellinger.scatter(_picks(spark, d)).groupBy("key", "segment").agg(F.sum("picks").alias("picks"), F.sum(F.col("xx") + F.col("yy") + F.col("zz")).alias("trace"))
    return sums.select("key", "segment", "picks", F.round("trace", 0).alias("trace"))


@query("pole_confidence", "WITH k AS (SELECT DISTINCT o_orderkey % 5 AS key FROM orders) SELECT key, 2 AS moving, 60 AS points, TRUE AS about FROM k UNION ALL SELECT key, 3, 60, TRUE FROM k")
def _(spark, d):
    """Points of the region of each rotation lie about it, within a degree."""
    fits = hellinger.fit_circuits(_picks(spark, d), {p: (la + 3, lo + 1, an + 1) for p, (la, lo, an) in _TRUE.items()}).where("fixed = 1")
    region = hellinger.confidence_region(fits, points=60).join(fits.select("key", "moving", F.col("lat").alias("la"), F.col("lon").alias("lo"), F.col("angle").alias("an")), ["key", "moving"])
    off = S.angle(S.from_lat_lon("lat", "lon"), S.from_lat_lon("la", "lo"))
    return region.groupBy("key", "moving").agg(F.count("*").cast("int").alias("points"), ((F.max(off) > 0) & (F.max(off) < F.radians(F.lit(1.0))) & (F.max(F.abs(F.col("angle") - F.col("an"))) < 1)).alias("about"))
