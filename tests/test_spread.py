"""Dear work for each row is spread over tasks, shapes are cut once, and points of multipoints are rows."""

import math

from pyspark.sql import functions as F

from driftplane.functions import sphere as S
from driftplane.operators import coregistration as K
from driftplane.operators import geometry, kinematics, partition, reconstruct
from driftplane.operators import rotation_model as R


def _one_task(spark, n=40):
    k = F.col("id")
    return spark.range(n).coalesce(1).select("id", S.from_lat_lon((k * 53 % 179 - 89).cast("double"), (k * 37 % 360 - 180).cast("double")).alias("v"))


def _halves(spark):
    """The north and the south as two polygons."""
    ring = lambda up: F.array(*(S.from_lat_lon(F.lit(0.0), F.lit(float(lon))) for lon in (range(0, 360, 90) if up else range(270, -90, -90))))
    both = [spark.range(1).select(F.lit(p).cast("long").alias("plate_id"), F.lit(p).cast("long").alias("input_order"), F.lit("static_polygon").alias("kind"), F.array(ring(up)).alias("rings")) for p, up in ((1, True), (2, False))]
    return partition.with_priority(both[0].unionByName(both[1]))


def _quarters(spark):
    ring = lambda a: F.array(*(S.from_lat_lon(F.lit(float(la)), F.lit(float(a + lo))) for la, lo in ((-60, 0), (-60, 80), (60, 80), (60, 0))))
    four = None
    for i in range(4):
        one = spark.range(1).select(F.lit(i).cast("long").alias("plate_id"), F.lit(i).cast("long").alias("input_order"), F.lit("static_polygon").alias("kind"), F.array(ring(90 * i - 180)).alias("rings"))
        four = one if four is None else four.unionByName(one)
    return partition.with_priority(four)


def _model(spark):
    rows = [(1, 1, 0, 0.0, 90.0, 0.0, 0.0, False), (1, 1, 0, 100.0, 40.0, 30.0, 50.0, False)]
    samples = spark.createDataFrame(rows, "seq long, moving long, fixed long, time double, lat double, lon double, angle double, disabled boolean")
    return R.rotations(samples, [0.0, 1.0, 60.0, 61.0])


def _tasks(df):
    return df.rdd.getNumPartitions()


def test_points_of_one_task_are_spread(spark):
    points = _one_task(spark)
    assert _tasks(points) == 1
    assert _tasks(partition.first_hit(points, _quarters(spark))) > 1
    plates = points.withColumn("plate_id", F.lit(1).cast("long"))
    assert _tasks(kinematics.kinematic_series(plates, _model(spark), [0.0, 60.0])) > 1
    assert _tasks(reconstruct.small_circles(plates.withColumns({"time": F.lit(60.0), "radius": F.lit(10.0)}), _model(spark))) > 1


def test_small_circles_are_as_destinations(spark):
    n = 12
    rows = _one_task(spark).withColumn("r", F.radians(F.col("id") % 80 + 1.0))
    plain = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: S.destination(F.col("v"), 2 * math.pi * i / n, F.col("r")))
    off = F.array_max(F.zip_with(S.small_circle(F.col("v"), F.col("r"), n), plain, lambda a, b: sum(F.abs(a[c] - b[c]) for c in "xyz")))
    assert rows.select(F.size(S.small_circle(F.col("v"), F.col("r"), n)).alias("n"), off.alias("off")).agg(F.min("n"), F.max("n"), F.max("off") < 1e-14).first()[:] == (n, n, True)


def test_nearest_distances_make_no_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(K, "within", None)
    seeds = _one_task(spark).select((F.col("id") + 100).alias("seed_id"), "v", (F.col("id") % 3).alias("t"))
    targets = _one_task(spark, 30).select("v", (F.col("id") % 3).alias("t"), (F.col("id") % 2 + 1).alias("_n"))
    got = {r[0]: (r[1], r[2]) for r in K.nearest_distance(seeds, targets, 4000.0, on=("t",)).collect()}
    right = targets.collect()
    assert len(got) == 40
    for s in seeds.collect():
        km = [(math.acos(max(-1.0, min(1.0, sum(a * b for a, b in zip(s["v"], t["v"], strict=True))))) * S.EQUATORIAL_RADIUS, t["_n"]) for t in right if t["t"] == s["t"]]
        near = [x for x in km if x[0] < 4000]
        least, n = got[s["seed_id"]]
        assert n == sum(k for _, k in near)
        assert (least is None) == (not near) and (not near or abs(least - min(near)[0]) < 1e-3)


def test_shapes_are_cut_once_and_multipoints_by_point(spark, monkeypatch):
    seen = []
    inner = partition._parts
    monkeypatch.setattr(partition, "_parts", lambda f, *a: seen.append(sorted(r[0] for r in f.select(F.size(F.flatten("rings"))).collect())) or inner(f, *a))
    line = lambda k: F.array(*(S.from_lat_lon(F.lit(la), k * 100.0 + 7) for la in (-50.0, 10.0, 70.0)))
    lines = spark.range(12).select("id", line((F.col("id") % 2).cast("double")).alias("line"))
    got = partition.split_lines(lines, _quarters(spark)).groupBy("id").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    assert len(got) == 12 and all(r["n"] == 2 and abs(r["size"] - math.radians(120)) < 1e-9 for r in got)
    assert seen == [[3, 3]]
    seen.clear()
    spots = F.array(*(S.from_lat_lon(F.lit(float(la)), F.lit(float(lo))) for la, lo in ((0, -170), (5, -80), (0, -170), (80, 0), (3, -79), (1, 190))))
    sets = spark.range(2).select("id", F.lit("multipoint").alias("gtype"), F.array(spots).alias("rings"))
    parts = partition.partition_geometries(sets, _quarters(spark)).orderBy("id", "nth").collect()
    assert [(r["id"], r["nth"], r["hit"], r["gtype"], r["size"], len(r["rings"][0])) for r in parts] == [(i, *x) for i in (0, 1) for x in ((0, 1, "multipoint", 2.0, 2), (1, 0, "multipoint", 3.0, 3), (2, None, "multipoint", 1.0, 1))]
    assert seen == [[1] * 5]


def test_crossings_with_few_arcs_are_a_broadcast(spark):
    lines = spark.range(6).coalesce(1).select("id", F.array(S.from_lat_lon(F.lit(-30.0), F.col("id") * 10.0 + 3), S.from_lat_lon(F.lit(30.0), F.col("id") * 10.0 + 3)).alias("line"))
    other = spark.range(1).select(F.lit("o").alias("id"), F.array(S.from_lat_lon(F.lit(0.0), F.lit(-10.0)), S.from_lat_lon(F.lit(0.0), F.lit(80.0))).alias("line"))
    found = geometry.crossings(geometry.segments(lines), geometry.segments(other), cell=0.25)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    whole = geometry.crossings(geometry.segments(lines), geometry.segments(other), cell=0.25, few=0)
    key = lambda df: sorted((r["left_id"], r["left_seg"], r["right_seg"]) for r in df.collect())
    assert key(found) == key(whole) and len(key(found)) == 6
    graph = geometry.intersection_graph(lines, other, cell=0.25)
    assert _tasks(graph) > 1 and graph.count() == 12
