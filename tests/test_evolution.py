"""Lines and polygons stepped through moving surfaces, both ways, split where vertices go."""

import math

import pytest
from pyspark.sql import functions as F

from driftplane.functions import sphere as S
from driftplane.operators import evolution, proximity
from driftplane.operators import rotation_model as R

HALVES = {1: [(-60, -60), (-60, 0), (60, 0), (60, -60)], 2: [(-60, 0), (-60, 60), (60, 60), (60, 0)]}


def ring(col="p"):
    return F.transform(col, lambda q: S.from_lat_lon(q["a"], q["o"]))


def shapes(spark, rows):
    flat = [(i, kind, [{"a": float(a), "o": float(o)} for a, o in pts]) for i, kind, pts in rows]
    return spark.createDataFrame(flat, "id long, gtype string, p array<struct<a: double, o: double>>").select("id", "gtype", F.array(ring()).alias("rings"))


def world(spark, times, rate=1.0):
    """Plate 1 stands still, plate 2 turns west about the poles by ``rate`` degrees a My as time
    goes on; the plates' outlines stay where they are."""
    halves = shapes(spark, [(k, "polygon", p) for k, p in HALVES.items()])
    t = spark.createDataFrame([(float(x),) for x in times], "time double")
    surfaces = halves.join(t).select("time", F.col("id").alias("plate_id"), "rings", F.struct("id").alias("priority"))
    samples = [(1, 1, 0, 0.0, 90.0, 0.0, 0.0), (1, 1, 0, 100.0, 90.0, 0.0, 0.0), (2, 2, 0, 0.0, 90.0, 0.0, 0.0), (2, 2, 0, 100.0, 90.0, 0.0, 100.0 * rate)]
    rows = spark.createDataFrame([(i, *s, False) for i, s in enumerate(samples)], "file_line long, seq int, moving long, fixed long, time double, lat double, lon double, angle double, disabled boolean")
    return surfaces, R.rotations(rows, [float(x) for x in times])


def lons(line):
    return [round(math.degrees(math.atan2(p.y, p.x)), 3) for p in line]


def test_vertices_are_close_and_keyed(spark):
    rows = [(1, "polyline", [(0, 0), (0, 10), (0, 10), (5, 10)]), (2, "polygon", [(0, 0), (0, 10), (10, 10)]), (3, "multipoint", [(0, 0), (50, 50)]), (4, "point", [(1, 1)]), (5, "polyline", [(3, 3)])]
    got = evolution.vertices(shapes(spark, rows), 0.05).select("id.*", "v").collect()
    by = {}
    for r in got:
        by.setdefault(r.feature, []).append(r)
    for k, v in by.items():
        v.sort(key=lambda r: r.nth)
        assert [r.nth for r in v] == list(range(v[0].n)), k
        if k < 3:
            steps = list(zip(v, v[1:] + v[:1] if k == 2 else v[1:], strict=False))
            assert all(math.acos(min(1, a.v.x * b.v.x + a.v.y * b.v.y + a.v.z * b.v.z)) <= 0.0501 for a, b in steps)
    assert len(by[3]) == 2 and len(by[4]) == 1 and len(by[5]) == 1


def test_lines_move_both_ways_and_split(spark):
    times = [10.0, 9.0, 8.0, 7.0, 11.0, 12.0]
    surfaces, model = world(spark, times)
    line, box = [(0, -7), (0, 7)], [(-3, -4), (-3, 4), (3, 4), (3, -4)]
    features = shapes(spark, [(1, "polyline", line), (2, "polygon", box), (3, "multipoint", [(0, -5), (0, 5)])])
    free = evolution.evolve(features, surfaces, model, times, 10.0, spacing=math.radians(1.0), deactivate=False)
    at = {(r.id, r.time): r for r in evolution.reassembled(free).collect()}
    assert set(at) == {(i, t) for i in (1, 2, 3) for t in times} and all(r.gtype == {1: "polyline", 2: "polygon", 3: "multipoint"}[r.id] for r in at.values())
    # as time goes on plate 2 goes west (its angle shrinks), and back in older times
    assert lons(at[1, 10.0].line) == [float(x) for x in range(-7, 8)]
    assert lons(at[1, 9.0].line)[-1] == 6.0 and lons(at[1, 12.0].line)[-1] == 9.0 and lons(at[1, 8.0].line)[0] == -7.0
    # vertices that change plates with another velocity near the border go; what is left are runs
    span = evolution.evolve(features, surfaces, model, times, 10.0, spacing=math.radians(1.0))
    parts = {}
    for r in evolution.reassembled(span).collect():
        parts.setdefault((r.id, r.time), []).append((r.piece, r.gtype, r.line))
    assert [k for _, k, _ in parts[1, 10.0]] == ["polyline"] and [k for _, k, _ in parts[2, 10.0]] == ["polygon"]
    pieces = sorted(parts[1, 8.0], key=lambda x: x[0])
    assert len(pieces) == 2 and pieces[0][0] == 0 and all(k == "polyline" for _, k, _ in pieces)
    gone = [r.id.nth for r in span.where("time = 8 and not active and id.feature = 1").collect()]
    assert gone and len(pieces[0][2]) + len(pieces[1][2]) + len(gone) == 15
    # a polygon falls into lines, one of which goes over its first vertex
    open_ = sorted(parts[2, 7.0], key=lambda x: x[0])
    assert all(k == "polyline" for _, k, _ in open_) and open_[0][0] < 0 and len(open_) == 2
    assert len(parts[3, 8.0]) == 1 and len(parts[3, 8.0][0][2]) == 2


def test_span_at_any_time(spark):
    times = [10.0, 9.0, 8.0]
    surfaces, model = world(spark, times)
    features = shapes(spark, [(1, "polyline", [(0, 20), (0, 30)])])
    span = evolution.evolve(features, surfaces, model, times, 10.0, spacing=math.radians(5.0))
    for t, first in ((10.0, 20.0), (9.5, 19.5), (8.25, 18.25), (8.0, 18.0)):
        got = evolution.geometries_at(span, t, 10.0, 1.0, 3).collect()
        assert [r.gtype for r in got] == ["polyline"] and lons(got[0].line)[0] == pytest.approx(first, abs=1e-3)
    assert evolution.geometries_at(span, 7.0, 10.0, 1.0, 3).count() == 0


def test_edges_in_reach(spark):
    edges = shapes(spark, [(1, "polyline", [(0, 0), (0, 80)]), (2, "polyline", [(10, 0), (10.01, 0.01)])]).select(F.col("id").alias("k"), F.col("rings")[0][0].alias("a"), F.col("rings")[0][1].alias("b"))
    pts = spark.createDataFrame([(1, 1, 1.0, 40.0, 2.0), (2, 1, 1.0, 40.0, 0.5), (3, 2, 10.5, 0.0, 1.0), (4, 2, 0.1, 40.0, 1.0), (5, 1, 0.0, 81.0, 1.5)], "id long, k long, a double, o double, r double").select("id", "k", S.from_lat_lon("a", "o").alias("v"), F.radians("r").alias("reach"))
    assert sorted(r.id for r in proximity.in_reach(pts, edges, by="k").collect()) == [1, 3, 5]
    assert proximity.in_reach(pts.limit(0), edges, by="k").count() == 0


def test_places_are_stepped_once(spark, monkeypatch):
    """Lines of one shape share their steps, and all of them are in the span."""
    from driftplane.operators import partition

    times = [10.0, 9.0]
    surfaces, model = world(spark, times)
    features = shapes(spark, [(i, "polyline", [(0, -7), (0, 7)] if i % 2 else [(2, -7), (2, 9)]) for i in range(40)]).coalesce(1)
    asked, first_hit = [], partition.first_hit

    def counted(points, *args, **more):
        asked.append(points.count())
        return first_hit(points, *args, **more)

    monkeypatch.setattr(partition, "first_hit", counted)
    span = evolution.evolve(features, surfaces, model, times, 10.0, spacing=1.0)
    assert asked == [4]
    rows = span.where("time = 9").select("id.feature", "id.nth", "v.x", "v.y", "v.z").collect()
    assert len(rows) == 80 and len({(r.feature % 2, r.nth, r.x, r.y, r.z) for r in rows}) == 4
