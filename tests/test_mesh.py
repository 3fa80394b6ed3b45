"""Triangulated networks: faces, strips, forced edges, blocks, location and weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftplane.functions import sphere as S
from driftplane.operators import mesh, partition, topology

POINTS = "time double, topology_id string, x double, y double, z double, u double, w double"


def frame(spark, nets):
    rows = [(0.0, name, 0.0, 0.0, 1.0, float(u), float(w)) for name, pts in nets.items() for u, w in pts]
    return spark.createDataFrame(rows, POINTS)


def faces(df):
    return sorted((r.topology_id, tuple(sorted([(r.u0, r.w0), (r.u1, r.w1), (r.u2, r.w2)]))) for r in df.collect())


def area(t):
    (a, b), (c, d), (e, f) = t
    return abs((c - a) * (f - b) - (d - b) * (e - a)) / 2


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 30, 400])
def test_circles_are_empty(n):
    p = np.random.default_rng(n).random((n, 2))
    t = mesh.delaunay(p)
    if n < 3:
        assert len(t) == 0
        return
    centre, reach = mesh._circles(p, t)
    far = np.linalg.norm(p[None] - centre[:, None], axis=2)
    assert (far >= reach[:, None] - 1e-9).all()
    e = p[t]
    turn = (e[:, 1] - e[:, 0])[:, 0] * (e[:, 2] - e[:, 0])[:, 1] - (e[:, 1] - e[:, 0])[:, 1] * (e[:, 2] - e[:, 0])[:, 0]
    assert (turn > 0).all()


def test_ten_thousand_points_take_seconds():
    import time

    p = np.random.default_rng(1).random((10_000, 2))
    start = time.time()
    t = mesh.delaunay(p)
    assert time.time() - start < 20
    # every edge belongs to two faces, or is one of the hull's h: Euler's count
    sides = {tuple(sorted(e)) for a, b, c in t.tolist() for e in ((a, b), (b, c), (c, a))}
    hull = 3 * len(t) - 2 * (3 * len(t) - len(sides))
    assert len(t) == 2 * len(p) - 2 - hull


def test_strips_make_the_same_faces(spark):
    r = np.random.default_rng(2)
    clumps = np.concatenate([r.normal(c, s, (150, 2)) for c, s in ((0, 0.001), (0.3, 0.05), (0.5, 0.2))])
    nets = {"even": r.random((700, 2)), "clumps": clumps, "grid": [(i / 100, j / 100) for i in range(20) for j in range(20)], "two": [(0, 0), (1, 1)], "line": [(i / 10, 0.0) for i in range(9)], "twice": [(0, 0), (1, 0), (0, 1), (0, 1)]}
    df = frame(spark, nets).repartition(3)
    whole = faces(mesh.triangulated(df, strip=10_000))
    assert faces(mesh.triangulated(df, strip=60)) == whole
    of = lambda name: [t for n, t in whole if n == name]
    assert len(of("grid")) == 2 * 19 * 19 and sum(map(area, of("grid"))) == pytest.approx(0.19**2)
    assert not of("two") and not of("line") and len(of("twice")) == 1


def test_forced_edges(spark):
    r = np.random.default_rng(3)
    pts = r.random((120, 2)) * 0.2 - 0.1
    centre = S.vector(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    v = S.normalise(S.vector(F.lit(1.0), F.col("u"), F.col("w")))
    df = frame(spark, {"n": [*pts, (-0.15, 0.0), (0.15, 0.003)]}).withColumn("v", v).withColumn("p", mesh.in_plane(F.col("v"), centre))
    df = df.select("time", "topology_id", "v.x", "v.y", "v.z", "p.u", "p.w")
    ends = df.orderBy("u").collect()
    point = lambda q: F.struct(*(F.lit(q[c]).alias(c) for c in ("x", "y", "z", "u", "w")))
    edge = spark.range(1).select(F.lit(0.0).alias("time"), F.lit("n").alias("topology_id"), point(ends[0]).alias("a"), point(ends[-1]).alias("b"))
    nets = spark.range(1).select(F.lit(0.0).alias("time"), F.lit("n").alias("topology_id"), centre.alias("centre"))
    plain, made = faces(mesh.triangulated(df)), faces(mesh.conforming(df, edge, nets))
    sides = {frozenset(e) for _, t in made for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
    at, end = (ends[0]["u"], ends[0]["w"]), (ends[-1]["u"], ends[-1]["w"])
    assert frozenset((at, end)) not in {frozenset(e) for _, t in plain for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
    steps = 0
    while at != end and steps < 200:  # along the edge, from one new point to the next
        on = [q for e in sides if at in e for q in e - {at} if q[0] > at[0] and abs(q[1] - ends[0]["w"] - (q[0] - ends[0]["u"]) * (end[1] - ends[0]["w"]) / (end[0] - ends[0]["u"])) < 1e-4]
        assert on, at
        at, steps = min(on), steps + 1
    assert at == end and steps > 1


def sections(spark, rows):
    """(topology, index, feature, [(lat, lon)], interior, block) as resolved sections."""
    flat = [(0.0, t, i, f, False, inner, block, [{"a": float(a), "o": float(o)} for a, o in pts]) for t, i, f, pts, inner, block in rows]
    df = spark.createDataFrame(flat, "time double, topology_id string, section_index int, feature_id long, reverse boolean, is_interior boolean, is_block boolean, p array<struct<a: double, o: double>>")
    return df.withColumn("line", F.transform("p", lambda q: S.from_lat_lon(q["a"], q["o"]))).drop("p")


BOX = [(-10, -10), (-10, 10), (10, 10), (10, -10)]
BLOCK = [(-3, -3), (-3, 3), (3, 3), (3, -3)]


def network(spark, forced, inner=40):
    r = np.random.default_rng(4)
    rows = [("n", i, i, [p, p], False, False) for i, p in enumerate(BOX)] + [("n", 9, 9, BLOCK, True, True)]
    rows += [("n", 10 + i, 10 + i, [tuple(p)], True, False) for i, p in enumerate(r.random((inner, 2)) * 18 - 9)]
    return topology.networks(sections(spark, rows), forced=forced)


def test_network_with_a_block(spark):
    of = lambda df: {r.region: r.size for r in df.groupBy("region").agg(F.sum(F.abs(S.triangle_area(*(F.element_at("vertices", i) for i in (1, 2, 3))))).alias("size")).collect()}
    ring = lambda pts: spark.createDataFrame([([{"a": float(a), "o": float(o)} for a, o in pts],)], "p array<struct<a: double, o: double>>").select(F.abs(S.ring_area(F.transform("p", lambda q: S.from_lat_lon(q["a"], q["o"]))))).first()[0]
    forced = network(spark, True)
    got = of(forced)
    assert got["rigid"] == pytest.approx(ring(BLOCK), rel=1e-3) and got["rigid"] + got["deforming"] == pytest.approx(ring(BOX), rel=1e-3)
    assert {r.block for r in forced.where("region = 'rigid'").select("block").distinct().collect()} == {"9"}
    assert forced.select("face").distinct().count() == forced.count()
    plain = of(network(spark, False))
    assert sum(plain.values()) == pytest.approx(ring(BOX), rel=1e-2) and network(spark, False).count() == 2 * 44 + 4 - 2


def test_networks_without_rows_and_too_wide(spark):
    none = sections(spark, [("n", 0, 0, BOX, False, False)]).limit(0)
    assert topology.networks(none).count() == 0 and topology.networks(none, forced=True).count() == 0
    assert mesh.triangulated(frame(spark, {"a": [(0, 0)]}).limit(0)).count() == 0
    wide = [("n", i, i, [p, p], False, False) for i, p in enumerate([(80, 0), (-60, 120), (-60, -120)])]
    with pytest.raises(ValueError, match="quarter turn"):
        topology.networks(sections(spark, wide))


def test_location_has_three_answers(spark):
    shape = lambda name, pts: spark.createDataFrame([(name, [{"a": float(a), "o": float(o)} for a, o in pts])], "topology_id string, p array<struct<a: double, o: double>>").withColumn("ring", F.transform("p", lambda q: S.from_lat_lon(q["a"], q["o"]))).drop("p")
    outlines = shape("n", BOX).unionByName(shape("m", [(20, 20), (20, 30), (30, 30), (30, 20)]))
    blocks = shape("n", BLOCK).withColumn("block", F.lit(9))
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, 25.0, 25.0), (4, 50.0, 0.0), (5, -89.0, 0.0)], "id long, a double, o double").select("id", S.from_lat_lon("a", "o").alias("v"))
    got = {r.id: (r.topology_id, r.region, r.block) for r in topology.locate(pts, outlines, blocks).collect()}
    assert got == {1: ("n", "rigid", 9), 2: ("n", "deforming", None), 3: ("m", "deforming", None), 4: (None, "outside", None), 5: (None, "outside", None)}


def test_cells_follow_size(spark):
    """Tiny faces and whole hemispheres: the same answer as testing every polygon, by lists and
    by joins; and a tiny face is in eight cells at most, of its own size."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(60):
        size, a, o = 10 ** r.uniform(-2, 1.7), r.uniform(-60, 60), r.uniform(-180, 180)
        rows.append((i, [{"a": a + size * x, "o": o + size * y} for x, y in ((0, 0), (1, 0), (0, 1))]))
    polys = spark.createDataFrame(rows, "plate_id long, p array<struct<a: double, o: double>>").select("plate_id", F.array(F.transform("p", lambda q: S.from_lat_lon(q["a"], q["o"]))).alias("rings"), F.struct("plate_id").alias("priority"))
    inside = polys.select(F.col("plate_id").alias("id"), S.normalise(S.add(S.add(F.col("rings")[0][0], F.col("rings")[0][1]), F.col("rings")[0][2])).alias("v"))
    some = spark.createDataFrame([(1000 + i, float(a), float(o)) for i, (a, o) in enumerate(zip(r.uniform(-90, 90, 300), r.uniform(-180, 180, 300), strict=True))], "id long, a double, o double").select("id", S.from_lat_lon("a", "o").alias("v"))
    pts = inside.unionByName(some)
    every = pts.crossJoin(polys).where(S.point_in_polygon(F.col("v"), F.col("rings"))).groupBy("id").agg(F.min("plate_id").alias("hit"))
    want = {r.id: r.hit for r in every.collect()}
    for few in (10**6, 0):
        got = {r.id: r.hit for r in partition.first_hit(pts, polys, few=few).collect() if r.hit is not None}
        assert got == want
    indexed, used = partition._in_cells(polys)
    assert len(used) > 3 and indexed.groupBy("hit").count().agg(F.max("count")).first()[0] <= 8
    assert {r.id for r in partition.first_hit(pts, polys.limit(0)).where("hit is null").collect()} == {r.id for r in pts.collect()}


def test_natural_weights(spark):
    """Weights are a partition of one, give the point as their mean, and are Voronoi areas."""
    r = np.random.default_rng(6)
    n = network(spark, False, inner=60)
    pts = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(r.uniform(-7, 7, (50, 2)))], "id long, a double, o double").select("id", S.from_lat_lon("a", "o").alias("v"), F.lit("n").alias("topology_id"))
    rows = mesh.natural_rows(pts, n)
    flat = rows.join(n.select("centre").limit(1)).withColumns({"p": mesh.in_plane(F.col("v"), F.col("centre")), "q": mesh.in_plane(F.col("vertex"), F.col("centre"))})
    sums = flat.groupBy("id").agg(F.sum("w").alias("w"), F.min("w").alias("least"), *((F.sum(F.col("w") * F.col(f"q.{c}")) - F.first(f"p.{c}")).alias(c) for c in "uw")).collect()
    assert len(sums) == 50
    for s in sums:
        assert s.w == pytest.approx(1) and s.least > -1e-6 and abs(s["u"]) < 1e-6
    # one point by sampling: what part of each vertex's cell is nearer to the point
    one = flat.where("id = 3").collect()
    sites = n.select(F.explode("vertices").alias("q"), "centre").distinct().select(mesh.in_plane(F.col("q"), F.col("centre")).alias("q")).collect()
    sites = np.array([(s.q.u, s.q.w) for s in sites])
    p = np.array([one[0].p.u, one[0].p.w])
    near = p + r.uniform(-0.12, 0.12, (200_000, 2))
    d = np.linalg.norm(near[:, None] - sites[None], axis=2)
    stolen = np.linalg.norm(near - p, axis=1) < d.min(1)
    owner = d.argmin(1)[stolen]
    for row in one:
        k = int(np.linalg.norm(sites - np.array([row.q.u, row.q.w]), axis=1).argmin())
        assert (owner == k).mean() == pytest.approx(row.w, abs=0.02)


def test_forced_networks_are_triangulated_once(spark, monkeypatch):
    """Forced edges across many strips: only what is about them is made again, and the faces are
    those of all points together."""
    p = np.concatenate([np.random.default_rng(8).uniform(-0.2, 0.2, (900, 2)), [(-0.19, -0.17), (0.18, 0.19), (-0.21, -0.21), (0.21, -0.21), (0.21, 0.21), (-0.21, 0.21)]])
    r = (p * p).sum(1)
    full = np.column_stack([p * np.sqrt(1 - r / 4)[:, None], 1 - r / 2, p]).tolist()
    points = spark.createDataFrame([(0.0, "n", *row) for row in full], POINTS)
    ends = [(-6, -5), (-4, -3), (-3, -2), (-2, -1), (-1, -4)]
    five = "struct<x: double, y: double, z: double, u: double, w: double>"
    edges = spark.createDataFrame([(0.0, "n", tuple(full[i]), tuple(full[j])) for i, j in ends], f"time double, topology_id string, a {five}, b {five}")
    nets = spark.createDataFrame([(0.0, "n", (0.0, 0.0, 1.0))], "time double, topology_id string, centre struct<x: double, y: double, z: double>")
    calls, whole = [], mesh.triangulated
    monkeypatch.setattr(mesh, "triangulated", lambda *a, **k: calls.append(1) or whole(*a, **k))
    got = faces(mesh.conforming(points, edges, nets, strip=150))
    assert len(calls) == 1
    spots = {q for _, t in got for q in t}
    assert len(spots) > len(p) and {tuple(q) for q in p.tolist()} <= spots
    assert got == faces(whole(frame(spark, {"n": sorted(spots)}), strip=100_000))
