"""Rotation model, reconstruction, co-registration, partitioning, kinematics, sources."""

import math
import random

import pytest
from pyspark.sql import functions as F

from driftplane import catalog
from driftplane.functions import palettes
from driftplane.functions import quaternion as Q
from driftplane.functions import sphere as S
from driftplane.operators import coregistration as C
from driftplane.operators import evolution, hellinger, kinematics, mesh, partition, proximity, raster, reconstruct, topology
from driftplane.operators import rotation_model as R
from driftplane.plans import cli
from driftplane.plans.session import Session, time_series
from driftplane.sources import features as X
from driftplane.sources import registry, text

#: Plates about the axes, a half turn in 300 My; commented-out lines; a plate about itself.
ROT = """999  0.0   0.0    0.0    0.0  999 ! title
101  0.0   0.0    0.0    0.0  000 ! about x
101 300.0   0.0    0.0 -180.0  000
102  0.0   0.0    0.0    0.0  000 ! about y
102 300.0   0.0   90.0  180.0  000
103  0.0  90.0    0.0    0.0  000
999 100.0  90.0    0.0   10.0  000 ! off
103 300.0  90.0    0.0  100.0  000
104  0.0  90.0    0.0    0.0  104
bad line
105  0.0 190.0    0.0    0.0  000
"""


@pytest.fixture()
def rot_file(tmp_path):
    p = tmp_path / "axes.rot"
    p.write_text(ROT)
    return str(p)


def model(spark, *rows):
    return spark.createDataFrame([(*r, False) for r in rows], "seq long, moving long, fixed long, time double, lat double, lon double, angle double, disabled boolean")


def vec(df, c="v"):
    return [tuple(round(x, 6) + 0.0 for x in r[c]) for r in df.select(c).collect()]


def test_rotation_file(spark, rot_file):
    good, bad = text.poles(spark, rot_file)
    assert bad.count() == 3
    rows = text.read_rotations(spark, rot_file).orderBy("line").collect()
    assert [(r.seq, r.moving, r.disabled) for r in rows] == [(1, 999, True), (2, 101, False), (2, 101, False), (3, 102, False), (3, 102, False), (4, 103, False), (4, 103, True), (4, 103, False)]


def test_sequences():
    g = R.group_sequences
    assert [x[0] for x in g([(1, 0, 0), (1, 10, 0), (1, 0, 0)])] == [1, 1, 2]  # earlier: new
    assert [x[0] for x in g([(1, 0, 0), (2, 10, 0)])] == [1, 2]  # other plate: new
    assert [x[0] for x in g([(1, 0, 0), (1, 0, 0)])] == [1, 2]  # equal time, enabled: new
    assert g([(1, 0, 0), (999, 10, 0), (1, 10, 0), (1, 20, 0)])[1:] == [(1, 1, 0, True), (1, 1, 0, False), (1, 1, 0, False)]
    assert [x[0] for x in g([(1, 0, 0), (999, 10, 5)])] == [1, 2]


def test_axis_rotation(spark, rot_file):
    samples = text.read_rotations(spark, rot_file)
    pts = spark.createDataFrame([(1, 102, 300.0, 0.0)], "id long, plate_id long, begin double, end double").withColumn("v", S.vector(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert vec(reconstruct.reconstruct(pts, samples, [150.0])) == [(1.0, 0.0, 0.0)]
    back = reconstruct.reverse_reconstruct(reconstruct.reconstruct(pts, samples, [75.0]).drop("time"), samples, 75.0)
    assert vec(back) == [(0.0, 0.0, 1.0)]


def test_rotation_properties(spark):
    r = random.Random(0)
    rows = [tuple(r.uniform(-80, 80) for _ in range(4)) + (r.uniform(-170, 170), r.uniform(-170, 170)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    q, p = Q.from_pole(F.col("a"), F.col("e"), F.col("f")), Q.from_pole(F.col("b"), F.col("f"), F.col("e"))
    v = S.from_lat_lon("c", "d")
    df = df.select(q.alias("q"), p.alias("p"), v.alias("v"))
    out = df.select(
        Q.multiply(F.col("q"), Q.conjugate(F.col("q")))["w"].alias("one"), S.norm(Q.rotate(F.col("q"), F.col("v"))).alias("len"), S.distance_km(Q.rotate(Q.multiply(F.col("q"), F.col("p")), F.col("v")), Q.rotate(F.col("q"), Q.rotate(F.col("p"), F.col("v")))).alias("off"),
        Q.inner(Q.slerp(F.col("q"), F.col("p"), F.lit(0.0)), F.col("q")).alias("s0"), F.abs(Q.inner(Q.slerp(F.col("q"), F.col("p"), F.lit(1.0)), F.col("p"))).alias("s1"), S.angle(Q.rotate(Q.between(F.col("v"), Q.rotate(F.col("p"), F.col("v"))), F.col("v")), Q.rotate(F.col("p"), F.col("v"))).alias("to"),
    ).collect()
    for x in out:
        assert abs(x.one - 1) < 1e-12 and abs(x.len - 1) < 1e-12 and x.off < 1e-3 and abs(x.s0 - 1) < 1e-9 and abs(x.s1 - 1) < 1e-9 and x.to < 1e-6


def test_circuit_claims_first(spark):
    # two sequences of one plate: the later one is tried first; 3 hangs on 2 the wrong way round
    edges = [(1, 2, 0, (1.0, 0.0, 0.0, 0.0)), (2, 2, 0, (0.0, 1.0, 0.0, 0.0)), (3, 0, 7, (0.0, 0.0, 1.0, 0.0))]
    found = {p: (parent, q) for p, parent, q, _ in R.circuit(edges, 0)}
    assert found[2] == (0, (0.0, 1.0, 0.0, 0.0)) and found[7][0] == 0 and found[7][1] == (0.0, 0.0, -1.0, 0.0)
    assert R.circuit([(i, i + 1, i, (1.0, 0.0, 0.0, 0.0)) for i in range(3000)], 0)[-1][0] == 3000


def test_model_edges(spark):
    m = model(spark, (1, 5, 0, 0.0, 90.0, 0.0, 0.0), (1, 5, 0, 10.0, 90.0, 0.0, 40.0), (2, 6, 0, 0.0, 90.0, 0.0, 0.0))
    assert {r.plate_id for r in R.rotations(m, [5.0]).collect()} == {0, 5}  # one sample is no sequence
    assert {r.plate_id for r in R.rotations(m, [50.0]).collect()} == set()
    far = R.extend_to_distant_past(R.usable(m))
    q = {r.plate_id: r.q for r in R.rotations(far, [50.0]).collect()}
    assert abs(q[5][0] - math.cos(math.radians(20))) < 1e-12
    pts = spark.createDataFrame([(9,)], "plate_id long").withColumn("time", F.lit(5.0))
    assert R.lookup(pts, R.rotations(m, [5.0])).first().q[0] == 1.0
    assert R.lookup(pts, R.rotations(m, [5.0]), strict=True).first().q is None
    with pytest.raises(ValueError, match="active edges"):
        R.rotations(m, [1.0, 2.0, 3.0], max_edges=2)
    new = R.with_adjustment(m, 5, 0, 5.0, 90.0, 0.0, 10.0, 1)
    assert new.where("time = 5").first().angle == pytest.approx(30.0)


def test_valid_time(spark):
    df = spark.createDataFrame([(10.0, 5.0), (None, 5.0), (10.0, None)], "begin double, end double")
    alive = lambda t: [r[0] for r in df.select(reconstruct.valid_at(t, F.col("begin"), F.col("end"))).collect()]
    assert alive(10.0) == [True, True, True] and alive(5.0) == [True, True, True] and alive(4.0) == [False, True, True]


SEEDS = "seed_id long, lat double, lon double, active boolean"


def test_reducers(spark):
    seeds = spark.createDataFrame([(1, 0.0, 0.0, True), (2, 80.0, 0.0, True), (3, 0.0, 0.0, False)], SEEDS).withColumn("v", S.from_lat_lon("lat", "lon"))
    rows = [(i, 0.0, 0.5 * i, x, s) for i, (x, s) in enumerate([(4.0, "b"), (1.0, "a"), (2.0, "b"), (None, "a")], 1)]
    t = spark.createDataFrame(rows, "target_id long, lat double, lon double, x double, s string").withColumn("v", S.from_lat_lon("lat", "lon")).drop("lat", "lon")
    config = [C.Column_("t", "x", r, 500.0) for r in ("min", "max", "mean", "median", "lookup")] + [C.Column_("t", "s", r, 500.0) for r in ("vote", "mean")] + [C.Column_("t", "n", "lookup", 500.0, "number_in_region"), C.Column_("t", "p", "lookup", 500.0, "presence"), C.Column_("t", "p", "min", 500.0, "presence"), C.Column_("t", "x", "vote", 500.0), C.Column_("t", "d", "min", 100.0, "distance")]
    out = {r[0]: r[1:] for r in C.coregister(seeds, {"t": t}, config).collect()}
    one = out[1]
    assert one[:5] == (1.0, 4.0, pytest.approx(7 / 3), 2.0, 4.0)
    assert one[5] == "a" and math.isnan(one[6]) and one[7] == 4 and one[8] is True and one[9] is None and one[10] == "1.0"
    assert one[11] == pytest.approx(math.radians(0.5) * 6378.137)
    assert out[2][:5] == (None,) * 5 and out[2][7] == 0 and out[2][8] is False
    assert out[3] == (None,) * 12
    cells = C.as_cells(C.coregister(seeds, {"t": t}, config)).where("seed_id = '3'").first()
    assert set(cells[1:]) == {"NaN"}


def test_upper_median(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([3.0, 1.0, 2.0],), ([None, 5.0],), ([],)], "x array<double>")
    assert [r[0] for r in df.select(C.upper_median(F.col("x"))).collect()] == [3.0, 2.0, 5.0, None]


def test_lookup_takes_smallest_area(spark):
    seeds = spark.createDataFrame([(1, 0.0, 0.0, True)], SEEDS).withColumn("v", S.from_lat_lon("lat", "lon"))
    t = spark.createDataFrame([(1, "big", 9.0), (2, "small", 1.0)], "target_id long, x string, area double").withColumn("v", S.vector(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    assert C.coregister(seeds, {"t": t}, [C.Column_("t", "x", "lookup", 10.0)]).first()[1] == "small"


def test_region_join_equals_brute_force(spark):
    r = random.Random(4)
    pts = [(i, math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for i in range(150)] + [(900, 90.0, 0.0), (901, -90.0, 7.0), (902, 0.0, 180.0), (903, 0.0, -180.0)]
    df = spark.createDataFrame(pts, "i long, lat double, lon double").withColumn("v", S.from_lat_lon("lat", "lon")).drop("lat", "lon")
    for km in (50.0, 700.0, 5000.0, 30000.0):
        got = {(x.seed_id, x.target_id) for x in C.within(df.withColumnRenamed("i", "seed_id"), df.withColumnRenamed("i", "target_id"), km).collect()}
        v = {i: (math.cos(math.radians(a)) * math.cos(math.radians(o)), math.cos(math.radians(a)) * math.sin(math.radians(o)), math.sin(math.radians(a))) for i, a, o in pts}
        want = {(a, b) for a in v for b in v if math.acos(max(-1, min(1, sum(x * y for x, y in zip(v[a], v[b], strict=True))))) < min(km / 6378.137, math.pi)}
        assert len(got ^ want) <= (0 if km < 20000 else 400)


def test_config_is_checked():
    assert C.parse_config(["# c", "f, Region_of_Interest(500), age, MEAN", "f, Region_of_Interest(10), DISTANCE, min", "", "x"])[1].mapper == "distance"
    with pytest.raises(ValueError):
        C.check_config([C.Column_("t", "x", "percentile")])
    with pytest.raises(ValueError):
        C.parse_config(["a, b"])


def polygon(spark, rows):
    ring = lambda pts: [[{"lat": float(a), "lon": float(o)} for a, o in pts]]
    df = spark.createDataFrame([(p, i, k, ring(pts)) for i, (p, k, pts) in enumerate(rows)], "plate_id long, input_order long, kind string, c array<array<struct<lat: double, lon: double>>>")
    return df.withColumn("rings", F.transform("c", lambda r: F.transform(r, lambda p: S.from_lat_lon(p["lat"], p["lon"])))).drop("c")


BOX = [(-10, -10), (-10, 10), (10, 10), (10, -10)]


@pytest.mark.parametrize("few", [20_000, 0])
def test_first_polygon_wins(spark, few):
    polys = partition.with_priority(polygon(spark, [(1, "static_polygon", BOX), (7, "static_polygon", [(-5, -5), (-5, 5), (5, 5), (5, -5)]), (3, "network", [(0, 0), (0, 3), (3, 3), (3, 0)])]))
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, -4.0, -4.0), (3, 8.0, 8.0), (4, 30.0, 0.0), (5, 0.0, -10.0)], "id long, lat double, lon double").withColumn("v", S.from_lat_lon("lat", "lon"))
    got = {r.id: r.hit for r in partition.first_hit(pts, polys, few=few).collect()}
    assert got == {1: 3, 2: 7, 3: 1, 4: None, 5: 1}
    assert [r.id for r in partition.outside(pts, polys, few=few).collect()] == [4]


def test_holes_and_areas(spark):
    ring = [[{"x": 1.0, "y": 0.0, "z": 0.0}, {"x": 0.0, "y": 1.0, "z": 0.0}, {"x": 0.0, "y": 0.0, "z": 1.0}]]
    df = spark.createDataFrame([(ring,)], "r array<array<struct<x: double, y: double, z: double>>>")
    assert df.select(S.polygon_area(F.col("r"))).first()[0] == pytest.approx(math.pi / 2)
    rev = df.select(S.ring_area(F.element_at("r", 1)), S.ring_area(F.reverse(F.element_at("r", 1)))).first()
    assert rev[0] == pytest.approx(-rev[1])
    outer, hole = polygon(spark, [(1, None, BOX)]).first().rings[0], polygon(spark, [(1, None, [(-2, -2), (-2, 2), (2, 2), (2, -2)])]).first().rings[0]
    p = spark.createDataFrame([([[tuple(x) for x in outer], [tuple(x) for x in hole]],)], "rings array<array<struct<x: double, y: double, z: double>>>")
    inside = p.select(S.point_in_polygon(S.from_lat_lon(F.lit(1.0), F.lit(1.0)), F.col("rings")), S.point_in_polygon(S.from_lat_lon(F.lit(6.0), F.lit(1.0)), F.col("rings"))).first()
    assert tuple(inside) == (False, True)


def test_split_lines(spark):
    polys = partition.with_priority(polygon(spark, [(1, "static_polygon", BOX)]))
    line = [{"lat": 0.0, "lon": -30.0}, {"lat": 0.0, "lon": 30.0}]
    df = spark.createDataFrame([(1, line)], "id long, c array<struct<lat: double, lon: double>>").withColumn("line", F.transform("c", lambda p: S.from_lat_lon(p["lat"], p["lon"]))).drop("c")
    out = partition.split_lines(df, polys).orderBy("nth").collect()
    assert [r.hit for r in out] == [None, 1, None]
    assert out[1].size == pytest.approx(math.radians(20), abs=1e-9)


def shapes(spark, rows):
    """(id, gtype, [(lat, lon), ...] or several such rings) as geometries."""
    many = lambda g: g if g and isinstance(g[0], list) else [g]
    data = [(i, k, [[{"lat": float(a), "lon": float(o)} for a, o in r] for r in many(g)]) for i, k, g in rows]
    df = spark.createDataFrame(data, "id long, gtype string, c array<array<struct<lat: double, lon: double>>>")
    return df.withColumn("rings", F.transform("c", lambda r: F.transform(r, lambda p: S.from_lat_lon(p["lat"], p["lon"])))).drop("c")


def test_geometries_are_cut_in_turn(spark):
    polys = partition.with_priority(polygon(spark, [(1, "static_polygon", BOX), (7, "static_polygon", [(-5, -5), (-5, 5), (5, 5), (5, -5)])]))
    rows = [
        (1, "polyline", [(0, -30), (0, 30)]), (2, "polygon", [(-2, -2), (-2, 2), (2, 2), (2, -2)]), (3, "polygon", [(-2, 0), (-2, 30), (2, 30), (2, 0)]),
        (4, "multipoint", [(0, 0), (8, 8), (50, 50), (1, 1)]), (5, "polygon", [[(-60, -60), (-60, 60), (60, 60), (60, -60)], [(-1, -1), (-1, 1), (1, 1)]]), (6, "polyline", [(70, 0), (80, 10)]), (7, "polyline", [(0, -5), (0, 5)]),
    ]
    out = partition.partition_geometries(shapes(spark, rows), polys).orderBy("id", "nth").collect()
    got = {}
    for r in out:
        got.setdefault(r.id, []).append((r.hit, r.gtype, round(math.degrees(r.size), 6) if "point" not in r.gtype else r.size))
    assert got[1] == [(None, "polyline", 20.0), (1, "polyline", 5.0), (7, "polyline", 10.0), (1, "polyline", 5.0), (None, "polyline", 20.0)]
    assert [x[:2] for x in got[2]] == [(7, "polygon")] and [x[:2] for x in got[6]] == [(None, "polyline")]
    assert sorted(x[0] or 0 for x in got[3]) == [0, 1, 1, 7] and {x[1] for x in got[3]} == {"polyline"}
    assert got[4] == [(7, "multipoint", 2.0), (1, "multipoint", 1.0), (None, "multipoint", 1.0)]
    assert [x[:2] for x in got[5]] == [(None, "polygon")] and [r.rings for r in out if r.id == 5][0][1]
    assert got[7] == [(7, "polyline", 10.0)]
    whole = {i: x for i, x in shapes(spark, rows).select("id", F.degrees(S.length(F.element_at("rings", 1)))).collect()}
    assert sum(x[2] for x in got[1]) == pytest.approx(whole[1])


def test_partitioned_features_take_properties(spark):
    polys = partition.with_priority(polygon(spark, [(102, "static_polygon", BOX)]).withColumns({"begin": F.lit(90.0), "conjugate_plate": F.lit(5)}))
    f = shapes(spark, [(1, "polyline", [(0, -30), (0, 30)]), (2, "polyline", [(0, 0), (0, 1)])]).withColumns({"plate_id": F.lit(9).cast("long"), "begin": F.lit(50.0), "end": F.lit(0.0), "time": F.when(F.col("id") == 1, 10.0).otherwise(60.0)})
    out = partition.partition_features(f, polys, take=("plate_id", "begin", "conjugate_plate")).collect()
    assert sorted((r.id, r.plate_id, r.begin, r.conjugate_plate, len(r.rings)) for r in out if r.id == 1 and r.conjugate_plate) == [(1, 102, 90.0, 5, 1)]
    assert sorted((r.id, r.plate_id, r.begin, len(r.rings)) for r in out if not r.conjugate_plate) == [(1, 9, 50.0, 2), (2, 9, 50.0, 1)]
    rot = R.rotations(model(spark, (1, 102, 0, 0.0, 90.0, 0.0, 0.0), (1, 102, 0, 100.0, 90.0, 0.0, 50.0)), [10.0])
    back = partition.partition_features(f.where("id = 1"), polys, rot).where("plate_id = 102").select(S.lon(F.element_at(F.element_at("rings", 1), 1))).first()[0]
    assert back == pytest.approx(-15)
    poles = spark.createDataFrame([(1, 0.0, 0.0, 70.0, 10.0), (2, 50.0, 0.0, 70.0, 10.0)], "id long, a double, o double, pa double, time double").withColumns({"site": S.from_lat_lon("a", "o"), "v": S.from_lat_lon("pa", "o"), "plate_id": F.lit(9).cast("long"), "begin": F.lit(99.0), "end": F.lit(0.0)})
    assert sorted((r.id, r.plate_id, round(r.l, 6)) for r in partition.assign_poles(poles, polys, rot).withColumn("l", S.lon(F.col("v"))).collect()) == [(1, 102, -5.0), (2, 9, 0.0)]


def test_geometry_distances(spark):
    rows = [
        (1, "point", [(0, 0)]), (2, "polyline", [(0, 10), (0, 40)]), (3, "polygon", [(-20, -20), (-20, 20), (20, 20), (20, -20)]), (4, "multipoint", [(50, 0), (3, 0)]), (5, "polygon", [(60, 100), (60, 140), (80, 120)]),
        (6, "polygon", [[(-20, -20), (-20, 20), (20, 20), (20, -20)], [(-4, -4), (-4, 4), (4, 4), (4, -4)]]), (7, "polyline", [(88, 0), (88, 180)]), (8, "point", [(-90, 0)]), (9, "polyline", [(5, 30)]),
    ]
    g = shapes(spark, rows)
    a, b = g.select(F.col("id").alias("x"), F.struct("gtype", "rings").alias("g")), g.select(F.col("id").alias("y"), F.struct("gtype", "rings").alias("h"))
    whole = {(r.x, r.y): r.d for r in a.crossJoin(b).select("x", "y", proximity.distance_km(F.col("g"), F.col("h")).alias("d")).collect()}
    deg = lambda k: whole[k] / 6378.137 * 180 / math.pi
    assert whole[1, 3] == whole[3, 2] == whole[3, 4] == 0 and deg((1, 2)) == pytest.approx(10) and deg((1, 4)) == pytest.approx(3) and deg((1, 6)) == pytest.approx(3.99, abs=0.02) and deg((9, 2)) == pytest.approx(5) and deg((7, 8)) == pytest.approx(178)
    for km in (50.0, 1000.0, 4000.0, 15000.0, 30000.0):
        got = {(r.x, r.y): r.dist_km for r in proximity.pairs_within(g.withColumnRenamed("id", "x"), g.withColumnRenamed("id", "y"), km, left_key="x", right_key="y").collect()}
        want = {k: d for k, d in whole.items() if d < min(km, math.pi * 6378.137) or km > math.pi * 6378.137}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got), km


def test_geometry_coregistration(spark):
    seeds = shapes(spark, [(1, "point", [(0, 0)]), (2, "polyline", [(0, 60), (0, 70)]), (3, "point", [(-80, 0)])]).withColumnRenamed("id", "seed_id").withColumns({"own": F.col("seed_id") * 10.5, "plate_id": F.lit(3), "name": F.lit("n"), "active": F.col("seed_id") < 3})
    rows = [(1, "polygon", BOX), (2, "polygon", [(-5, -5), (-5, 5), (5, 5), (5, -5)]), (3, "polyline", [(10, 65), (20, 65)]), (3, "point", [(1, 1)]), (4, "point", [(0, 20)])]
    attrs = {1: '{"AGE": 5, "KIND": "a"}', 2: '{"AGE": 7.5, "KIND": "b"}', 3: '{"AGE": "old", "KIND": "b"}', 4: '{"KIND": "c"}'}
    t = shapes(spark, rows).withColumnRenamed("id", "target_id")
    t = t.withColumns({"plate_id": F.col("target_id") * 100, "x": F.col("target_id") * 1.0, "attributes": F.create_map(F.lit("AGE"), F.try_variant_get(F.parse_json(F.create_map(*(F.lit(z) for kv in attrs.items() for z in kv))[F.col("target_id")]), "$.AGE", "variant"), F.lit("KIND"), F.try_variant_get(F.parse_json(F.create_map(*(F.lit(z) for kv in attrs.items() for z in kv))[F.col("target_id")]), "$.KIND", "variant"))})
    c = lambda *a, **k: C.Column_("t", *a, **k)
    config = [c("x", "lookup", 1500.0), c("n", "lookup", 1500.0, "number_in_region"), c("distance", "min", 3000.0, "distance"), c("plate_id", "mean", 1500.0), c("plate_id", "vote", 1500.0), c("AGE", "max", 3000.0, "attribute"), c("KIND", "vote", 3000.0, "attribute"), c("own", "mean"), c("own", "lookup"), c("name", "mean"), c("plate_id", "min"), c("p", "lookup", None, "presence"), c("x", "median", 3000.0), c("x", "percentile", 3000.0, percent=25.0), c("x", "weighted_mean", 3000.0, weight="x")]
    out = {r[0]: list(r[1:]) for r in C.coregister(seeds, {"t": t}, config).collect()}
    nan = lambda x: isinstance(x, float) and math.isnan(x)
    assert out[1][:3] == [2.0, 3, 0.0]  # at distance 0 the smaller polygon
    assert nan(out[1][3]) and out[1][4] == "100" and out[1][5] == 7.5 and out[1][6] == '"b"' or out[1][6] == "b"
    assert out[1][7:9] == [10.5, 10.5] and nan(out[1][9]) and out[1][10] is None and out[1][11] is True
    assert out[1][12] == 3.0 and out[1][13] == 1.0 and out[1][14] == pytest.approx(30 / 10)
    assert out[2][0] == 3.0 and out[2][2] == pytest.approx(math.radians(10) * 6378.137) and out[2][7] == 21.0
    assert out[3] == [None] * len(config)


def test_arcs(spark):
    v = lambda la, lo: S.from_lat_lon(F.lit(float(la)), F.lit(float(lo)))
    one = spark.range(1).select(
        F.degrees(S.point_to_arc(v(10, 20), v(0, 0), v(0, 40))).alias("a"), F.degrees(S.point_to_arc(v(0, 60), v(0, 0), v(0, 40))).alias("b"), S.arcs_cross(v(-5, 10), v(5, 10), v(0, 0), v(0, 40)).alias("c"), S.arcs_cross(v(-5, 50), v(5, 50), v(0, 0), v(0, 40)).alias("d"),
        S.lon(S.arc_intersection(v(-5, 10), v(5, 10), v(0, 0), v(0, 40))).alias("e"), F.size(S.tessellate(v(0, 0), v(0, 40), math.radians(10.001))).alias("f"), F.size(S.small_circle_great_circle(v(0, 0), F.lit(math.radians(30)), v(90, 0))).alias("g"), S.lon(S.closest_on_arc(v(10, 20), v(0, 0), v(0, 40))).alias("h"),
    ).first()
    assert one.a == pytest.approx(10) and one.b == pytest.approx(20) and one.c and not one.d and one.e == pytest.approx(10) and one.f == 5 and one.g == 2 and one.h == pytest.approx(20)


def test_velocity_at_equator(spark):
    # a degree a My about the pole: 6378.137 km * pi / 180 / My
    df = spark.range(1).select(kinematics.velocity(S.vector(F.lit(1.0), F.lit(0.0), F.lit(0.0)), Q.from_pole(F.lit(90.0), F.lit(0.0), F.lit(1.0)), F.lit(1.0)).alias("v"))
    assert vec(df) == [(0.0, round(6378.137 * math.pi / 1800, 6), 0.0)]
    i = spark.range(1).select(kinematics.interval(F.lit(0.3), F.lit(1.0), "centred").alias("i")).first().i
    assert tuple(i) == (1.0, 0.0)


def test_net_rotation_of_one_plate(spark):
    grid = kinematics.whole_degree_grid(spark).where("lon < 180").withColumn("plate_id", F.lit(1).cast("long"))
    stage = spark.range(1).select(F.lit(1).cast("long").alias("plate_id"), Q.from_pole(F.lit(90.0), F.lit(0.0), F.lit(5.0)).alias("q"))
    total = kinematics.net_rotation_total(kinematics.net_rotation_by_plate(grid, stage, 10.0)).first()
    assert total.lat == pytest.approx(90, abs=1e-6) and total.rate == pytest.approx(0.5, rel=1e-6)


def test_strain(spark):
    g = kinematics.tensor(F.lit(0.1), F.lit(0.0), F.lit(0.0), F.lit(-0.1))
    row = spark.range(1).select(kinematics.style(g).alias("s"), kinematics.second_invariant(g).alias("i"), kinematics.dilatation_rate(g).alias("d")).first()
    assert row.s == pytest.approx(0) and row.i == pytest.approx(math.sqrt(0.02)) and row.d == 0
    steps = spark.createDataFrame([(1, float(20 - k), 0.01) for k in range(21)], "id long, t double, r double").withColumn("g", kinematics.tensor(F.col("r"), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    f = kinematics.accumulate_by(steps, "id", "t", "g").first().f
    assert f.tt == pytest.approx(math.exp(0.2), rel=1e-4) and f.pp == 1


def test_flowline_ends_half_way(spark):
    m = model(spark, (1, 1, 0, 0.0, 90.0, 0.0, 0.0), (1, 1, 0, 20.0, 90.0, 0.0, 40.0), (2, 2, 0, 0.0, 90.0, 0.0, 0.0), (2, 2, 0, 20.0, 90.0, 0.0, 0.0))
    seeds = spark.createDataFrame([(1, 1, 2, 0.0)], "id long, left long, right long, time double").withColumn("v", S.vector(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    got = {r.side: len(r.points) for r in reconstruct.flowlines(seeds, R.rotations(m, [0.0, 10.0, 19.0]), [0.0, 10.0, 19.0]).collect()}
    assert got == {"left": 3, "right": 3}
    ends = reconstruct.flowlines(seeds, R.rotations(m, [0.0, 10.0, 19.0]), [0.0, 10.0, 19.0]).select("side", S.lon(F.element_at("points", -1)).alias("lon")).collect()
    assert sorted(round(r.lon, 6) for r in ends) == [-19.0, 19.0]


def test_topology_is_closed_by_crossings(spark):
    import numpy as np

    p = lambda la, lo: np.array([math.cos(math.radians(la)) * math.cos(math.radians(lo)), math.cos(math.radians(la)) * math.sin(math.radians(lo)), math.sin(math.radians(la))])
    sides = [np.array([p(-5, -8), p(-5, 0), p(-5, 8)]), np.array([p(-8, 5), p(0, 5), p(8, 5)]), np.array([p(5, 8), p(5, 0), p(5, -8)]), np.array([p(8, -5), p(0, -5), p(-8, -5)])]
    ring = topology.assemble(sides, [False] * 4)
    assert len(ring) == 8
    tri = mesh.delaunay(np.array([[0.0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.4]]))
    area = lambda t: abs(np.linalg.det(np.array([[*x, 1] for x in np.array([[0.0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.4]])[t]]))) / 2
    assert len(tri) == 4 and sum(map(area, tri)) == pytest.approx(1)


def pt(la, lo):
    import numpy as np

    return np.array([math.cos(math.radians(la)) * math.cos(math.radians(lo)), math.cos(math.radians(la)) * math.sin(math.radians(lo)), math.sin(math.radians(la))])


def test_sections_that_meet_often():
    import numpy as np

    zigzag = np.array([pt(*x) for x in [(-5, 0), (5, 2), (-5, 4), (5, 6), (-5, 8)]])  # crosses the equator four times
    line = np.array([pt(0, -10), pt(0, 20)])
    end = np.array([pt(-20, 19), pt(20, 19)])
    got = topology.pieces([line, zigzag, end], [False] * 3)
    # the first meeting along the earlier section; the zigzag goes on from there
    assert got[1].lo == pytest.approx(0.5, abs=1e-3) and got[1].hi == 4 and got[0].hi < 1
    back = topology.pieces([line, zigzag, end], [False, True, False])
    assert (back[1].lo, back[1].backwards) == (0.0, True) and back[1].hi == pytest.approx(0.5, abs=1e-3)
    two = topology.pieces([line, zigzag], [False, False])
    assert two[0].lo < two[0].hi and two[1].backwards and (two[1].lo, two[1].hi) == (pytest.approx(0.5, abs=1e-3), pytest.approx(1.5, abs=1e-3))
    assert len(topology.assemble([line, end], [False, False], closed=False)) == 3
    alone = topology.pieces([line, np.array([pt(50, 0), pt(50, 9)])], [False, False])
    assert [(p.lo, p.hi) for p in alone] == [(0.0, 1.0)] * 2


def test_topologies_resolve_in_three_passes(spark):
    # two boxes side by side; their common side is a topological line of two features
    sides = {1: [(0, -10), (0, 10)], 2: [(10, 10), (10, -10)], 3: [(-1, -8), (11, -8)], 4: [(-1, 8), (11, 8)], 5: [(-1, 0), (6, 0)], 6: [(4, 0.001), (11, 0)]}
    geo = shapes(spark, [(i, "polyline", g) for i, g in sides.items()]).select(F.lit(0.0).alias("time"), F.col("id").alias("feature_id"), F.element_at("rings", 1).alias("line"))
    rows = [(50, "line", 0, 5, False), (50, "line", 1, 6, False)]
    rows += [(100, "boundary", 0, 1, False), (100, "boundary", 1, 50, False), (100, "boundary", 2, 2, False), (100, "boundary", 3, 3, True)]
    rows += [(200, "boundary", 0, 1, False), (200, "boundary", 1, 4, False), (200, "boundary", 2, 2, False), (200, "boundary", 3, 50, True)]
    rows += [(300, "network", 0, 1, False), (300, "network", 1, 4, False), (300, "network", 2, 2, False), (300, "network", 3, 3, True)]
    sec = spark.createDataFrame([(t, k, i, f, r, 0.0, False) for t, k, i, f, r in rows], "topology_id long, kind string, section_index int, feature_id long, reverse boolean, time double, is_interior boolean")
    out = topology.resolve(sec, geo)
    assert out["lines"].count() == 1 and out["networks"].select("topology_id").distinct().count() == 1
    area = {r.topology_id: r.a for r in out["boundaries"].select("topology_id", F.abs(S.ring_area(F.col("ring"))).alias("a")).collect()}
    want = math.radians(8) * math.sin(math.radians(10))
    assert area[100] == pytest.approx(want, rel=0.02) and area[200] == pytest.approx(want, rel=0.02)
    both = geo.unionByName(out["lines"].select("time", F.col("topology_id").alias("feature_id"), "line"))
    parts = topology.sub_segments(topology.resolve_sections(sec.where("kind = 'boundary'").drop("kind"), both))
    shared = {(r.feature_id, tuple(r.topologies)): r.reversed for r in topology.shared_sub_segments(parts).collect()}
    assert (50, (100, 200)) in shared and (1, (100,)) in shared and (1, (200,)) in shared and shared[50, (100, 200)] == [200]


def test_smoothed_strain(spark):
    tri = [(1, 0, [(0, 0), (0, 10), (10, 5)], 1.0), (1, 1, [(0, 10), (10, 15), (10, 5)], 3.0)]
    df = shapes(spark, [(f, "polygon", g) for _, f, g, _ in tri]).join(spark.createDataFrame([(f, x) for _, f, _, x in tri], "id long, x double"), "id")
    faces = df.select(F.lit(1).alias("topology_id"), F.col("id").cast("int").alias("face"), F.element_at("rings", 1).alias("vertices"), kinematics.tensor(F.col("x"), F.lit(0.0), F.lit(0.0), F.col("x")).alias("g"))
    pts = spark.createDataFrame([(1, 3.0, 5.0), (2, 7.0, 10.0), (3, 5.0, 7.5), (4, 40.0, 0.0)], "id long, a double, o double").select("id", S.from_lat_lon("a", "o").alias("v"))
    got = {m: {r.id: r.x for r in topology.strain_at(pts, faces, m).select("id", F.col("g.tt").alias("x")).collect()} for m in topology.SMOOTHING}
    assert got["none"][1] == 1.0 and got["none"][2] == 3.0 and all(4 not in g for g in got.values())
    for m in ("barycentric", "natural_neighbour"):
        assert 1.0 < got[m][1] < got[m][3] < got[m][2] < 3.0 and got[m][3] == pytest.approx(2.0, abs=0.1)
    with pytest.raises(ValueError):
        topology.strain_at(pts, faces, "other")


def test_reconstruction_by_topologies(spark):
    m = model(spark, (1, 1, 0, 0.0, 90.0, 0.0, 0.0), (1, 1, 0, 100.0, 90.0, 0.0, 50.0), (2, 2, 0, 0.0, 90.0, 0.0, 0.0), (2, 2, 0, 100.0, 90.0, 0.0, -50.0))
    times = [10.0, 9.0, 8.0, 7.0]
    rot = R.rotations(m, times)
    boxes = partition.with_priority(polygon(spark, [(1, "boundary", [(-10, -60), (-10, 0), (10, 0), (10, -60)]), (2, "boundary", [(-10, 0), (-10, 60), (10, 60), (10, 0)])]))
    surfaces = boxes.crossJoin(spark.createDataFrame([(t,) for t in times[:-1]], "time double"))
    pts = spark.createDataFrame([(1, 0.0, -30.0), (2, 0.0, 30.0), (3, 80.0, 0.0), (4, 0.0, 0.2)], "id long, a double, o double").select("id", S.from_lat_lon("a", "o").alias("v"))
    out = evolution.reconstruct_by_topologies(pts, surfaces, rot, times)
    at = {(r.id, r.time): (round(r.lon, 6), r.plate_id, r.active) for r in out.withColumn("lon", S.lon(F.col("v"))).collect()}
    assert at[1, 7.0] == (-31.5, 1, True) and at[2, 7.0] == (31.5, 2, True) and at[3, 7.0][1:] == (None, True)
    assert at[4, 9.0] == (0.7, 2, True) and len(at) == 16
    # a plate that swallows the point: it leaves plate 2 for plate 1 near the boundary, fast
    grown = partition.with_priority(polygon(spark, [(1, "boundary", [(-10, -60), (-10, 1.2), (10, 1.2), (10, -60)]), (2, "boundary", [(-10, 1.2), (-10, 60), (10, 60), (10, 1.2)])]))
    later = surfaces.where("time = 10").unionByName(grown.crossJoin(spark.createDataFrame([(9.0,), (8.0,)], "time double")))
    gone = evolution.reconstruct_by_topologies(pts.where("id = 4"), later, rot, times)
    assert [(r.time, r.active) for r in gone.orderBy(F.desc("time")).collect()] == [(10.0, True), (9.0, False), (8.0, False), (7.0, False)]
    kept = evolution.reconstruct_by_topologies(pts.where("id = 4"), later, rot, times, deactivate=False)
    assert kept.where("not active").count() == 0
    tri = shapes(spark, [(1, "polygon", [(-5, -35), (-5, -25), (5, -30)]), (2, "polygon", [(-5, -33), (-5, -23), (5, -28)])])
    ring = {r.id: r.rings[0] for r in tri.collect()}
    faces = spark.createDataFrame([(10.0, 1, 0, [tuple(p) for p in ring[1]], [tuple(p) for p in ring[2]])], "time double, topology_id int, face int, vertices array<struct<x: double, y: double, z: double>>, next array<struct<x: double, y: double, z: double>>")
    moved = evolution.reconstruct_by_topologies(pts.where("id = 1"), surfaces, rot, [10.0, 9.0], faces=faces).where("time = 9").select(S.lon(F.col("v"))).first()[0]
    assert moved == pytest.approx(-28, abs=0.01)
    half = evolution.span_at(out, 9.5, 10.0, 1.0, 4).withColumn("lon", S.lon(F.col("v")))
    assert {r.id: round(r.lon, 4) for r in half.collect()}[1] == -30.25
    assert evolution.span_at(out, 3.0, 10.0, 1.0, 4).count() == 0 and evolution.span_at(out, 9.0, 10.0, 1.0, 4).count() == 4


def test_smoothing_near_boundaries(spark):
    m = model(spark, (1, 1, 0, 0.0, 90.0, 0.0, 0.0), (1, 1, 0, 100.0, 90.0, 0.0, 50.0), (2, 2, 0, 0.0, 90.0, 0.0, 0.0), (2, 2, 0, 100.0, 90.0, 0.0, -50.0))
    rot = R.rotations(m, [10.0, 11.0])
    boxes = partition.with_priority(polygon(spark, [(1, "boundary", [(-20, -60), (-20, 0), (20, 0), (20, -60)]), (2, "boundary", [(-20, 0), (-20, 60), (20, 60), (20, 0)])]))
    pts = spark.createDataFrame([(1, 0.0, -10.0), (2, 0.0, -1.0), (3, 0.0, 1.0), (4, 0.0, -1e-6)], "id long, a double, o double").select("id", F.lit(10.0).alias("time"), S.from_lat_lon("a", "o").alias("v"), F.col("o"))
    out = evolution.smooth_near_boundaries(pts.drop("o"), boxes, rot, 1.0, math.radians(2))
    east = {r.id: r.e for r in out.join(pts.select("id", "o"), "id").select("id", kinematics.colatitude_longitude(F.col("velocity"), F.lit(0.0), F.col("o"))["lon"].alias("e")).collect()}
    full = math.radians(0.5) * 637.8137
    assert east[1] == pytest.approx(-full, rel=1e-6) and east[2] == pytest.approx(-full / 2, rel=0.01) and east[3] == pytest.approx(full / 2, rel=0.01) and abs(east[4]) < 1e-3


def test_pole_fit_recovers_a_rotation():
    import numpy as np

    true = hellinger._matrix(40.0, -30.0, 12.0)
    lat, lon, moving, segment = [], [], [], []
    for s, (a, o) in enumerate([(10, 10), (20, 40), (-10, 60), (35, 20)]):
        for k in range(6):
            x = np.radians([a + k, o + (k if s % 2 else -k)])
            v = np.array([math.cos(x[0]) * math.cos(x[1]), math.cos(x[0]) * math.sin(x[1]), math.sin(x[0])])
            for m in (False, True):
                w = true.T @ v if m else v
                lat.append(math.degrees(math.asin(w[2])))
                lon.append(math.degrees(math.atan2(w[1], w[0])))
                moving.append(m)
                segment.append(s)
    pole, value = hellinger.fit(lat, lon, moving, segment, np.ones(len(lat)), (38.0, -28.0, 11.0))
    # a short great circle fixes little along itself: the misfit is what must vanish
    assert value < 1e-3 and np.abs(pole - [40, -30, 12]).max() < 15


def test_palette(spark, tmp_path):
    p = tmp_path / "a.cpt"
    p.write_text("# comment\n0 0 0 0 10 100 0 0\n10 100 0 0 20 0 0 200\nB 1 1 1\nF 2 2 2\nN 3 3 3\n")
    pal = text.read_palette(spark, str(p))
    df = spark.createDataFrame([(-1.0,), (5.0,), (15.0,), (21.0,), (float("nan"),)], "x double")
    got = [tuple(r.c) for r in df.select(palettes.colour(F.col("x"), pal).alias("c")).collect()]
    assert got == [(1, 1, 1), (50, 0, 0), (50, 0, 100), (2, 2, 2), (3, 3, 3)]


XML = """<f:FeatureCollection xmlns:f="urn:x" xmlns:gml="http://www.opengis.net/gml">
<gml:featureMember><f:Coastline><f:identity>A1</f:identity><gml:name>x &amp; y</gml:name>
<f:reconstructionPlateId><f:ConstantValue><f:value>101</f:value></f:ConstantValue></f:reconstructionPlateId>
<gml:validTime><gml:TimePeriod><gml:begin><gml:TimeInstant><gml:timePosition>urn:distantPast</gml:timePosition></gml:TimeInstant></gml:begin><gml:end><gml:TimeInstant><gml:timePosition>5</gml:timePosition></gml:TimeInstant></gml:end></gml:TimePeriod></gml:validTime>
<f:centerLine><gml:LineString><gml:posList>0 10 5 20</gml:posList></gml:LineString></f:centerLine></f:Coastline></gml:featureMember>
<gml:featureMember><f:Basin><f:identity>B</f:identity><f:outline><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 0 5 5 5 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></f:outline></f:Basin></gml:featureMember>
<gml:featureMember><f:Site><f:identity>C</f:identity><f:position><gml:Point><gml:pos>1 2</gml:pos></gml:Point></f:position></f:Site></gml:featureMember>
</f:FeatureCollection>"""


def test_xml_round_trip(spark, tmp_path):
    import gzip

    (tmp_path / "a.gpml").write_text(XML)
    (tmp_path / "b.gpmlz").write_bytes(gzip.compress(XML.encode()))
    cols = ["feature_id", "feature_type", "name", "plate_id", "begin", "end", "gtype", "rings"]
    one = registry.read(spark, str(tmp_path / "a.gpml")).select(*cols).orderBy("feature_id").collect()
    assert (one[0].name, one[0].plate_id, one[0].begin, one[0].end, one[0].gtype) == ("x & y", 101, float("inf"), 5.0, "polyline")
    assert len(one[1].rings[0]) == 3 and one[2].rings[0][0].lat == 1.0
    assert registry.read(spark, str(tmp_path / "b.gpmlz")).select(*cols).orderBy("feature_id").collect() == one
    registry.convert(spark, str(tmp_path / "a.gpml"), str(tmp_path / "out.gpml"))
    assert registry.read(spark, str(tmp_path / "out.gpml")).select(*cols).orderBy("feature_id").collect() == one
    registry.convert(spark, str(tmp_path / "a.gpml"), str(tmp_path / "out.geojson"))
    again = registry.read(spark, str(tmp_path / "out.geojson")).select("gtype", "rings").collect()
    assert sorted(again) == sorted((r.gtype, r.rings) for r in one)
    (tmp_path / "c.gpml").write_text("<broken")
    assert X.read_xml_errors(spark, str(tmp_path / "c.gpml")).count() == 1


def test_line_files(spark, tmp_path):
    f = spark.createDataFrame([(1, "CS", "west", 101, 200.0, float("-inf"), [(1.5, 2.5), (3.0, 4.0)])], "line long, feature_type string, name string, plate_id long, begin double, end double, coordinates array<struct<lat: double, lon: double>>")
    registry.write(f, str(tmp_path / "a.dat"))
    got = registry.read(spark, str(tmp_path / "a.dat")).first()
    assert (got.plate_id, got.begin, got.end, got.gtype, got.name) == (101, 200.0, float("-inf"), "polyline", "west")
    assert [tuple(p) for p in got.coordinates] == [(1.5, 2.5), (3.0, 4.0)]
    registry.write(f, str(tmp_path / "a.xy"))
    assert spark.read.text(str(tmp_path / "a.xy")).count() == 3


def test_other_sources(spark, tmp_path, rot_file):
    (tmp_path / "a.vgp").write_text("title\n 10 50.0 5.0 100.0 -30.0 20.0 10.0 -50.0 4.0 5.0 60.0 120.0\nshort 1 2\n")
    assert registry.read(spark, str(tmp_path / "a.vgp")).first().lon == 120.0
    (tmp_path / "ages").write_text("# Chron M1 M2\nC5 9.7 10.1\nC6 19 -\n")
    assert sorted((r.model, r.chron, r.age) for r in text.read_age_model(spark, str(tmp_path / "ages")).collect()) == [("M1", "C5", 9.7), ("M1", "C6", 19.0), ("M2", "C5", 10.1)]
    (tmp_path / "picks").write_text("1 1 10.0 20.0 5.0\n2 1 11.0 21.0 5.0\n31 2 1 2 3\n")
    assert [(r.moving, r.enabled) for r in text.read_picks(spark, str(tmp_path / "picks")).orderBy("line").collect()] == [(False, True), (True, True), (False, False)]
    (tmp_path / "a.grot").write_text('@FILE"x"\n> @MPRS:pid"101" @name "A"\n101 0.0 90.0 0.0 0.0 000 @C"one"\n101 10.0 90.0 0.0 5.0 000\n#101 20.0 90.0 0.0 5.0 000\n')
    rows = registry.read(spark, str(tmp_path / "a.grot")).orderBy("line").collect()
    assert [(r.seq, r.moving, r.disabled) for r in rows] == [(1, 101, False), (1, 101, False), (1, 101, True)] and rows[0].attributes["FILE"] == "x"
    registry.write(text.read_rotations(spark, rot_file), str(tmp_path / "b.rot"))
    assert text.read_rotations(spark, str(tmp_path / "b.rot")).count() == 8
    assert text.config_section(["[a]", "x", "# no", "y", "", "z"], "a") == ["x", "y"]
    with pytest.raises(ValueError):
        registry.format_of("a.unknown")


def geometries(spark):
    rows = [
        ("a", "polygon", [[(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)], [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0)]], 101, 2.5), ("b|\"c", "polygon", [[(50.0, 0.0), (60.0, 10.0), (50.0, 20.0)]], None, None),
        ("l", "polyline", [[(0.5, -1.25), (3.0, 4.0)]], 7, 1.0), ("p", "point", [[(12.5, 100.0)]], -3, 0.125), ("é", "multipoint", [[(1.0, 2.0), (3.0, 4.0)]], 0, -1.5),
    ]
    data = [(n, k, [[{"lat": a, "lon": o} for a, o in r] for r in g], i, x) for n, k, g, i, x in rows]
    return spark.createDataFrame(data, "name string, gtype string, rings array<array<struct<lat: double, lon: double>>>, plate_id long, x double")


def same_ring(a, b):
    """Whether two rings have the same corners, whatever their start and direction."""
    return sorted(tuple(p) for p in a) == sorted(tuple(p) for p in b)


def test_shapefiles(spark, tmp_path):
    df = geometries(spark)
    registry.write(df, f"{tmp_path}/out/f.shp")
    back = registry.read(spark, f"file://{tmp_path}/out/f_polygon.shp").orderBy("nth").collect()
    want = df.where("gtype = 'polygon'").collect()
    assert len(back) == 2
    for w in want:
        got = next(r for r in back if same_ring(r.rings[0], w.rings[0]))
        assert len(got.rings) == len(w.rings) and all(same_ring(x, y) for x, y in zip(got.rings, w.rings, strict=True)) and got.attributes["name"].toPython() == w["name"]
        assert (got.attributes["plate_id"].toPython() if w.plate_id is not None else None) == w.plate_id
    for kind in ("point", "multipoint", "polyline"):
        r, w = registry.read(spark, f"file://{tmp_path}/out/f_{kind}.shp").collect()[0], df.where(F.col("gtype") == kind).first()
        assert r.gtype == kind and r.rings == w.rings and float(r.attributes["x"].toPython()) == w.x
    from driftplane.sources import vectors

    shp, _ = vectors.shapes_of("polyline", [[[(0.0, 0.0), (1.0, 1.0)]]])
    with pytest.raises(vectors.Invalid):
        list(vectors.parse_shapes(shp[:-4]))
    with pytest.raises(vectors.Invalid):
        list(vectors.parse_shapes(b"x" * 200))


def test_gmt_attributes(spark, tmp_path):
    df = geometries(spark)
    for kind in ("polygon", "polyline", "point", "multipoint"):
        some = df.where(F.col("gtype") == kind)
        registry.write(some, f"{tmp_path}/{kind}.gmt")
        back = registry.read(spark, f"{tmp_path}/{kind}.gmt").orderBy("nth").collect()
        want = some.collect()
        assert [(r.gtype, r.rings) for r in back] == [(w.gtype, w.rings) for w in want]
        assert [r.attributes["name"].toPython() for r in back] == [w["name"] for w in want]
        assert [r.attributes["plate_id"].toPython() for r in back if r.attributes["plate_id"] and r.attributes["plate_id"].toPython() is not None] == [w.plate_id for w in want if w.plate_id is not None]


def test_grids_picks_and_exports(spark, tmp_path):
    from driftplane.sources import vectors

    px = spark.createDataFrame([("b", 10.0, 0.0, 1.5, 1.0), ("b", 0.0, 5.0, 2.0, 0.0), ("c", 0.0, 0.0, 9.0, 1.0)], "band string, lat double, lon double, value double, coverage double")
    vectors.write_grid(px, f"{tmp_path}/g", "b")
    back = X.read_grid(spark, f"{tmp_path}/g", "r").orderBy("lat").collect()
    assert [(r.lat, r.lon, r.coverage) for r in back] == [(0.0, 5.0, 0.0), (10.0, 0.0, 1.0)] and back[1].value == 1.5
    with pytest.raises(ValueError, match="not numbers"):
        vectors.check_numeric(px.withColumn("value", F.lit("red")), "b")
    picks = spark.createDataFrame([(1, False, 1, 10.0, 20.0, 5.0, True), (2, True, 1, 11.0, 21.0, 5.0, False)], "line long, moving boolean, segment int, lat double, lon double, sigma double, enabled boolean")
    text.write_lines(vectors.pick_lines(picks), f"{tmp_path}/picks")
    assert [tuple(r)[2:] for r in text.read_picks(spark, f"{tmp_path}/picks").orderBy("line").collect()] == [tuple(r)[1:] for r in picks.collect()]
    pts = spark.createDataFrame([("f", 1, 1.0, 2.0, 0.5), ("f", 0, 3.0, 4.0, 1e-15), ("a", 0, 0.0, 0.0, 2.0)], "feature_id string, point_idx int, lat double, lon double, dilatation double")
    lines = [r.value for r in vectors.deformation_lines(pts, "dilatation").orderBy("line").collect()]
    assert lines == ["> a", "0.000000 0.000000 2.00000000e+00", "> f", "3.000000 4.000000 1.00000000e-15", "1.000000 2.000000 5.00000000e-01"]
    rings = shapes(spark, [(5, "polygon", BOX)]).select(F.col("id").alias("topology_id"), F.element_at("rings", 1).alias("ring"))
    out = vectors.topology_lines(rings).first().value.split("\n")
    assert out[0] == "> 5" and out[1] == out[-1] == "-10.000000 -10.000000" and len(out) == 6


def test_geojson_is_a_stream_of_lines(spark, tmp_path):
    df = geometries(spark).repartition(4)
    registry.write(df, f"{tmp_path}/f.geojson")
    back = X.read_geojson(spark, f"{tmp_path}/f.geojson").collect()
    assert sorted((r.gtype, str(r.rings)) for r in back) == sorted((r.gtype, str(r.rings)) for r in df.collect())
    registry.write(df.limit(0), f"{tmp_path}/none.geojson")
    assert X.read_geojson(spark, f"{tmp_path}/none.geojson").count() == 0


def test_many_rotation_files(spark, tmp_path, rot_file):
    for i in range(3):
        (tmp_path / f"m{i}.rot").write_text(ROT)
    rows = text.read_rotations(spark, f"{tmp_path}/m*.rot")
    assert rows.select("seq").distinct().count() == 12 and rows.where("seq is null").count() == 0
    (tmp_path / "p.cpt").write_text("0 0 0 0 1 1 1 1\n" * 9)
    with pytest.raises(ValueError, match="max_lines"):
        text.read_palette(spark, str(tmp_path / "p.cpt"), max_lines=5)


def test_csv_quoting(spark):
    df = spark.createDataFrame([("a,b", None), (' x"', 1.5)], "s string, x double")
    assert [r[0] for r in X.to_csv_lines(df).collect()] == ['"a,b",NaN', '" x""",1.5']


def test_command_line(spark, tmp_path, rot_file):
    (tmp_path / "a.gpml").write_text(XML)
    cli.main(["reconstruct", "--features", str(tmp_path / "a.gpml"), "--rotations", rot_file, "--time", "10", "--output", str(tmp_path / "o.geojson")], spark)
    assert registry.read(spark, str(tmp_path / "o.geojson")).count() == 3
    assert cli.main(["equivalent-rotation", "--rotations", rot_file, "--plate", "103", "--time", "150"], spark).startswith("(90.0000")
    assert cli.main(["stage-rotation", "--rotations", rot_file, "--plate", "103", "--time", "0", "--time2", "0", "--identity", "pole"], spark) == "(90.0, 0.0, 0.0)"
    assert time_series(10, 0, 5) == [10, 5, 0]


def test_session(spark, tmp_path, rot_file):
    (tmp_path / "a.gpml").write_text(XML)
    s = Session(spark)
    s.load(str(tmp_path / "a.gpml"))
    s.load(rot_file)
    assert s.reconstruct(times=[0.0, 10.0]).count() == 5 and s.features("a").count() == 3


def test_raster_rows_share_the_finest_level(spark):
    px = spark.createDataFrame([(0, 0.0, 0.0, 1e9 + 1, 1.0), (0, 0.0, 1.0, 1e9 + 3, 1.0), (1, 0.0, 0.5, 5.0, 1.0)], "level int, lat double, lon double, value double, coverage double")
    seeds = spark.createDataFrame([(1, 0.0, 0.5), (2, 80.0, 0.0)], "seed_id long, a double, o double").select("seed_id", S.from_lat_lon("a", "o").alias("v"))
    rows = [raster.RasterRow("mean", 100.0, 1), raster.RasterRow("std_dev", 100.0, 0), raster.RasterRow("max", 200.0, 1)]
    out = {r[0]: tuple(r[1:]) for r in raster.coregister_raster(seeds, px, rows).collect()}
    assert out[1] == (pytest.approx(1e9 + 2), pytest.approx(1.0, abs=1e-6), 1e9 + 3) and out[2] == (None, None, None)
    with pytest.raises(ValueError):
        raster.coregister_raster(seeds, px, [raster.RasterRow("vote", 100.0)])


def test_raster_levels(spark):
    px = spark.createDataFrame([("r", "b", 0, i, j, float(i + j), 1.0) for i in range(4) for j in range(4)], "raster_id string, band string, level int, row long, col long, value double, coverage double")
    up = raster.coarser(px)
    assert up.count() == 4 and up.where("row = 0 and col = 0").first().value == 1.0
    assert raster.coarser(up).first().value == 3.0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracles(spark, name):
    import oracle

    assert oracle.compare(spark, "/root/testdata/sf0.001", catalog.QUERIES[name], catalog.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_sql(spark, name):
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_generated_points(spark):
    from driftplane.operators import generate as G

    for level, n in ((0, 30), (2, 480)):
        pts = G.uniform_points(spark, level, offset=0.5)
        assert pts.count() == n
        m = pts.agg(*(F.avg(f"v.{c}").alias(c) for c in "xyz")).first()
        assert max(abs(m.x), abs(m.y), abs(m.z)) < 0.1
    assert len(G.rhombi()) == 30 and G.mesh_caps(spark, 5).count() == 300 and G.mesh_icosahedral(spark, 3).count() == 90
    distinct = G.mesh_caps(spark, 5).select(*(F.round(f"v.{c}", 9) + 0.0 for c in "xyz")).distinct().count()
    assert distinct == 12 * 16 + 2  # shared edges meet
    assert G.lat_lon_grid(spark, 30.0).count() == 7 * 13
    assert G.in_extent(G.lat_lon_grid(spark, 30.0), 0, 90, 170, 190).where("lon not in (180, -180)").count() == 0


def test_crossings_and_dateline(spark):
    from driftplane.operators import geometry as G

    line = lambda *p: [{"lat": float(a), "lon": float(o)} for a, o in p]
    df = spark.createDataFrame([(1, line((0, 0), (10, 10), (0, 10), (10, 0))), (2, line((-5, 170), (5, -170), (8, -175)))], "id long, coordinates array<struct<lat: double, lon: double>>")
    lines = df.withColumn("line", F.transform("coordinates", lambda p: S.from_lat_lon(p["lat"], p["lon"])))
    found = G.self_crossings(lines).collect()
    assert [(r.left_id, r.left_seg, r.right_seg) for r in found] == [(1, 0, 2)]
    parts = G.wrap_dateline(df.where("id = 2")).orderBy("part").collect()
    assert [[p.lon for p in r.coordinates] for r in parts] == [[170.0, 180.0], [-180.0, -170.0, -175.0]]
    mid = G.interpolated_lines(spark.range(1).select(F.array(*(S.from_lat_lon(F.lit(0.0), F.lit(float(x))) for x in (0, 10))).alias("from_line"), F.array(*(S.from_lat_lon(F.lit(20.0), F.lit(float(x))) for x in (0, 10))).alias("to_line")), [0.5], 4)
    lat = mid.select(F.transform("line", lambda p: S.lat(p)).alias("l")).first().l
    assert len(lat) == 5 and lat[0] == pytest.approx(10)
    poly = lines.where("id = 1").select(F.array("line").alias("rings"))
    assert poly.select(F.size(G.to_polyline(F.col("rings"), F.lit("polygon")))).first()[0] == 5


def test_surface_velocities(spark):
    polys = partition.with_priority(polygon(spark, [(5, "boundary", BOX)]))
    m = model(spark, (1, 5, 0, 0.0, 90.0, 0.0, 0.0), (1, 5, 0, 10.0, 90.0, 0.0, 10.0))
    pts = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 40.0, 0.0, 1.0)], "id long, lat double, lon double, time double").withColumn("v", S.from_lat_lon("lat", "lon"))
    out = {r.id: r for r in kinematics.surface_velocities(pts, polys, R.rotations(m, [1.0, 2.0]), 1.0).collect()}
    assert out[1].reason == "in_boundary" and out[1].velocity is not None and out[2].reason == "none" and out[2].velocity is None


def test_small_circle_about_the_planes_pole(spark):
    v = lambda a, o: S.from_lat_lon(F.lit(float(a)), F.lit(float(o)))
    n = lambda c, p: F.size(S.small_circle_great_circle(c, F.lit(0.6), p))
    same, opposite, across = v(0, 0), v(0, 180), v(20, 90)
    assert tuple(spark.range(1).select(n(same, same).alias("a"), n(same, v(0, 180)).alias("b"), n(v(90, 0), v(-90, 0)).alias("c"), n(opposite, across).alias("d")).first()) == (0, 0, 0, 2)


def test_seeds_and_targets_of_one_place_are_a_site(spark):
    seeds = spark.createDataFrame([(i, 0.0, 10.0 * (i % 2), True) for i in range(40)], SEEDS).withColumn("v", S.from_lat_lon("lat", "lon"))
    # target 99 is at two places, and is one target
    rows = [(i, 1.0 * (i % 2), float(i), "ab"[i % 3 == 0]) for i in range(60)] + [(99, 0.0, 7.0, "b"), (99, 1.0, 7.0, "b")]
    t = spark.createDataFrame(rows, "target_id long, lat double, x double, s string").withColumn("v", S.from_lat_lon("lat", F.lit(0.0)))
    named, sites = C.seed_sites(seeds, "seed_id")
    assert sites.count() == 2 and {(r.seed_id, r._s) for r in named.collect()} == {(i, i % 2) for i in range(40)}
    config = [C.Column_("t", "x", "lookup", 500.0), C.Column_("t", "n", "lookup", 500.0, "number_in_region"), C.Column_("t", "x", "percentile", 500.0, percent=10.0), C.Column_("t", "s", "vote", 500.0), C.Column_("t", "x", "mean", 500.0)]
    out = {r[0]: tuple(r[1:]) for r in C.coregister(seeds, {"t": t.withColumn("input_order", -F.col("target_id"))}, config).collect()}
    assert all(out[i] == (7.0, 61, 6.0, "a", pytest.approx((sum(range(60)) + 14) / 62)) for i in range(0, 40, 2))
    assert all(out[i][:2] == (None, 0) for i in range(1, 40, 2))


def test_lookup_of_equal_distances_takes_the_first(spark):
    seeds = spark.createDataFrame([(1, 0.0, 0.0, True)], SEEDS).withColumn("v", S.from_lat_lon("lat", "lon"))
    t = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.0 - 1e-9, 6.0)], "target_id long, lat double, x double").withColumn("v", S.from_lat_lon("lat", F.lit(0.0)))
    found = lambda **k: C.coregister(seeds, {"t": t}, [C.Column_("t", "x", "lookup", 500.0, **k)]).first()[1]
    assert found() == 6.0 and found(tie_km=1e-6) == 5.0


def test_pixels_of_one_place_are_summed_first(spark):
    px = spark.createDataFrame([(0.0, 0.0, float(i), 1.0) for i in range(9)] + [(0.0, 60.0, 5.0, 1.0)], "lat double, lon double, value double, coverage double")
    assert raster._places(px.select(S.from_lat_lon("lat", "lon").alias("v"), "value", F.col("coverage").alias("weight"))).count() == 2
    seeds = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 120.0)], "seed_id long, lon double").withColumn("v", S.from_lat_lon(F.lit(0.0), "lon"))
    out = {r.seed_id: (r.min, r.max, r.mean, r.pixels) for r in raster.region_statistics(seeds, px, 500.0).collect()}
    assert out == {1: (0.0, 8.0, 4.0, 9), 2: (0.0, 8.0, 4.0, 9), 3: (None, None, None, None)}


def test_compiled_distance_of_a_point_to_a_piece(spark):
    r = random.Random(8)
    at = lambda: {c: r.uniform(-1, 1) for c in "abc"}
    rows = [[x for _ in range(3) for x in (80 * at()["a"], 180 * at()["b"])] for _ in range(60)] + [[5.0, 5.0, 9.0, 9.0, 9.0, 9.0], [9.0, 9.0, 9.0, 9.0, 9.0, 9.0]]
    df = spark.createDataFrame(rows, "pa double, po double, aa double, ao double, ba double, bo double").select(*(S.from_lat_lon(f"{c}a", f"{c}o").alias(c) for c in "pab"))
    got = df.select(proximity._point_to_piece("p", "a", "b").alias("x"), S.point_to_arc(F.col("p"), F.col("a"), F.col("b")).alias("y")).collect()
    assert len(got) == 62 and all(g.x == pytest.approx(g.y, abs=1e-12) for g in got)
