"""Reconstruction by topologies: points, lines and polygons stepped through moving surfaces.

A step is one job over all points: those in a deforming face move with its corners, others
with the plate that holds them.  Points of one place go the same way and are stepped once.  Steps
follow from one another, so a run is a loop; every step is written once to the folder that
``spark.checkpoint.dir`` names, which cuts the lineage, and its rows are a part of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..functions import sphere as S
from . import kinematics, mesh, partition, proximity, topology
from . import rotation_model as R
from .shared import settled, spread

#: cm/yr by which a point's velocity may change, km/My from a boundary.
VELOCITY_CHANGE, BOUNDARY_DISTANCE = 0.7, 10.0


def _lost(moved: DataFrame, here: DataFrame) -> DataFrame:
    """Ids of points (id, v, left, reach) that are nearer than their reach to the outline of the
    plate that they left, or whose plate has no outline any more.  Outlines are met edge by
    edge."""
    ring = F.explode("rings").alias("_ring")
    edges = here.select(F.col("plate_id").cast("long").alias("left"), ring).select("left", F.explode(S._edges(F.col("_ring"))).alias("e")).select("left", "e.a", "e.b")
    near = proximity.in_reach(moved, edges, by="left").select("id")
    return near.unionByName(moved.join(edges.select("left").distinct(), "left", "left_anti").select("id")).distinct()


def _places(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, v) of the different places of points (id, v), and (id, _place) of every point."""
    points = points.select("id", "v")
    places = settled(points.select("v").distinct().select(F.monotonically_increasing_id().alias("id"), "v"))
    return places, settled(points.join(places.select(F.col("id").alias("_place"), "v"), "v").select("id", "_place"))


def _named(span: DataFrame, names: DataFrame) -> DataFrame:
    """A span of places as one of the points there."""
    rest = [c for c in span.columns if c != "id"]
    return names.join(span.withColumnRenamed("id", "_place"), "_place").select("id", *rest)


def _stages(model: DataFrame, t: float, u: float) -> DataFrame:
    """(plate, stage): every plate's rotation from ``t`` to ``u``, as ``q``, its ``axis``, and the
    cm/yr ``rate`` a quarter turn from it; plates that stand still have no rate."""
    at = lambda time, name: model.where(F.col("time") == float(time)).select(F.col("plate_id").cast("long").alias("plate"), F.col("q").alias(name))
    both = at(t, "a").join(at(u, "b"), "plate", "full")
    both = both.select("plate", kinematics.stage_quaternion(F.coalesce("a", Q.identity()), F.coalesce("b", Q.identity())).alias("q"))
    rate = F.when(~Q.is_identity(F.col("q")), kinematics.speed(F.col("q"), F.lit(abs(t - u))))
    return both.select("plate", F.struct("q", Q.axis(F.col("q")).alias("axis"), rate.alias("rate")).alias("stage"))


def reconstruct_by_topologies(points: DataFrame, surfaces: DataFrame, model: DataFrame, times: list[float], *, faces: DataFrame | None = None, deactivate: bool = True, velocity_change: float = VELOCITY_CHANGE, boundary_distance: float = BOUNDARY_DISTANCE) -> DataFrame:
    """(id, time, v, plate_id, active): points (id, v) at the first time, at all times.

    ``surfaces``: (time, plate_id, rings, priority) at all times but the last; ``model``:
    rotations at all times; ``faces``: (time, topology_id, face, vertices, next) of deforming
    networks, with the corners at the next time.  A point in no surface keeps its last
    plate, or stays.  One that changes plates is deactivated if its velocity changes by more
    than ``velocity_change`` and it is nearer to the outline of the plate it left than
    ``boundary_distance`` and the change of velocity would carry it."""
    places, names = _places(points)
    options = {"faces": faces, "deactivate": deactivate, "velocity_change": velocity_change, "boundary_distance": boundary_distance}
    return _named(_stepped(places, surfaces, settled(model), times, **options), names)


def _stepped(points: DataFrame, surfaces: DataFrame, model: DataFrame, times: list[float], *, faces: DataFrame | None = None, deactivate: bool = True, velocity_change: float = VELOCITY_CHANGE, boundary_distance: float = BOUNDARY_DISTANCE) -> DataFrame:
    """:func:`reconstruct_by_topologies` of points of different places."""
    state = points.select("id", "v", F.lit(None).cast("long").alias("plate_id"), F.lit(True).alias("active"))
    out = []
    for i, t in enumerate(times):
        here = surfaces.where(F.abs(F.col("time") - t) < R.TIME_EPSILON) if i < len(times) - 1 else None
        if here is None:
            out.append(state.select("id", F.lit(float(t)).alias("time"), "v", "plate_id", "active"))
            break
        u = times[i + 1]
        step = abs(t - u)
        found = partition.first_hit(state.where("active"), here.select("plate_id", "rings", "priority")).withColumn("now", F.coalesce("hit", "plate_id").cast("long"))
        stages = settled(_stages(model, t, u))
        for name, plate in (("_new", "now"), ("_old", "plate_id")):
            found = found.join(F.broadcast(stages.select(F.col("plate").alias("_p"), F.col("stage").alias(name))), F.col(plate) == F.col("_p"), "left").drop("_p")
        if deactivate:
            zero = S.vector(F.lit(0.0), F.lit(0.0), F.lit(0.0))
            fast = lambda s: F.when(F.col(f"{s}.rate").isNull(), zero).otherwise(S.scale(S.cross(F.col(f"{s}.axis"), F.col("v")), F.col(f"{s}.rate")))
            change = S.norm(S.add(fast("_new"), S.scale(fast("_old"), F.lit(-1.0))))
            found = settled(found.withColumn("_change", change))
            moved = found.where(F.col("plate_id").isNotNull() & (F.col("plate_id") != F.col("now")) & (F.col("_change") > velocity_change))
            # cm/yr are 10 km/My
            reach = (boundary_distance + 10 * F.col("_change")) * step / S.EQUATORIAL_RADIUS
            lost = _lost(settled(moved.select("id", "v", F.col("plate_id").alias("left"), reach.alias("reach"))), here)
            found = found.join(lost.select("id", F.lit(False).alias("_gone")), "id", "left").withColumn("_live", F.coalesce("_gone", F.lit(True)))
        else:
            found = found.withColumn("_live", F.lit(True))
        go = found.select("id", "v", "now", "_live", F.when(F.col("_new").isNull(), F.col("v")).otherwise(Q.rotate(F.col("_new.q"), F.col("v"))).alias("_next"))
        if faces is not None:
            go = _deformed(go, faces.where(F.abs(F.col("time") - t) < R.TIME_EPSILON))
        gone = state.where("not active").select("id", "v", F.col("plate_id").alias("now"), F.lit(False).alias("_live"), F.col("v").alias("_next"))
        done = settled(go.unionByName(gone))
        out.append(done.select("id", F.lit(float(t)).alias("time"), "v", F.col("now").alias("plate_id"), F.col("_live").alias("active")))
        state = done.select("id", F.when(F.col("_live"), S.normalise(F.col("_next"))).otherwise(F.col("v")).alias("v"), F.col("now").alias("plate_id"), F.col("_live").alias("active"))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def _deformed(rows: DataFrame, faces: DataFrame) -> DataFrame:
    """Points in a face go where its corners go, by their weights there."""
    one = faces.select(F.struct("topology_id", "face", "vertices", "next").alias("plate_id"), F.array("vertices").alias("rings"), F.struct("topology_id", "face").alias("priority"))
    hit = partition.first_hit(rows, one)
    corner = lambda c, i: F.element_at(F.col(f"hit.{c}"), i)
    w = topology.barycentric(F.col("v"), *(corner("vertices", i) for i in (1, 2, 3)))
    hit = hit.withColumn("_w", F.when(F.col("hit").isNotNull(), w))
    mixed = S.add(S.add(S.scale(corner("next", 1), F.col("_w.a")), S.scale(corner("next", 2), F.col("_w.b"))), S.scale(corner("next", 3), F.col("_w.c")))
    return hit.withColumn("_next", F.when(F.col("hit").isNotNull(), mixed).otherwise(F.col("_next"))).drop("hit", "_w")


#: Radians between neighbouring vertices of geometries that are stepped through topologies.
SPACING = 0.01


def vertices(features: DataFrame, spacing: float = SPACING, *, key: str = "id") -> DataFrame:
    """(id, v) of the vertices of features (key, gtype, rings), at most ``spacing`` radians apart.
    ``id`` tells feature, part, kind, place in the part from 0, and the part's number of
    vertices, which all times share."""
    part = features.select(F.col(key).alias("feature"), "gtype", F.posexplode("rings").alias("part", "ring")).where(F.size("ring") > 0)
    closed, spots = F.col("gtype") == "polygon", F.col("gtype").isin("point", "multipoint")
    edges = S._edges(F.col("ring"))
    edges = F.when(closed, edges).otherwise(F.slice(edges, 1, F.greatest(F.size("ring") - 1, F.lit(0))))
    along = F.flatten(F.transform(edges, lambda e: F.when(e["a"] == e["b"], F.array(e["a"])).otherwise(S.let(lambda t: F.slice(t, 1, F.size(t) - 1), S.tessellate(e["a"], e["b"], spacing)))))
    path = F.when(spots, F.col("ring")).when(closed, along).otherwise(F.concat(along, F.array(F.element_at("ring", -1))))
    rows = part.withColumn("path", path).select("feature", "part", "gtype", F.size("path").alias("n"), F.posexplode("path").alias("nth", "v"))
    return rows.select(F.struct("feature", "part", "gtype", "nth", "n").alias("id"), "v")


def reassembled(span: DataFrame, *, key: str = "id") -> DataFrame:
    """(key, part, time, piece, gtype, line) of vertices (id of :func:`vertices`, time, v, active):
    the geometries of the vertices that are still active.

    A polygon all of whose vertices are is one; of others, runs of neighbours are lines, where
    a polygon's last run goes on with its first; a run of one vertex is a point, and points
    stay together.  ``piece`` is the place of a run's first vertex."""
    rows = span.where("active").select("id.*", "time", "v")
    by = Window.partitionBy("time", "feature", "part")
    spots = F.col("gtype").isin("point", "multipoint")
    rows = rows.withColumn("run", F.when(spots, 0).otherwise(F.col("nth") - F.row_number().over(by.orderBy("nth"))))
    rows = rows.withColumns({"left": F.count("*").over(by), "least": F.min("nth").over(by), "most": F.max("nth").over(by), "last": F.max("run").over(by)})
    whole = (F.col("gtype") == "polygon") & (F.col("left") == F.col("n"))
    wraps = (F.col("gtype") == "polygon") & ~whole & (F.col("least") == 0) & (F.col("most") == F.col("n") - 1) & (F.col("run") == F.col("last"))
    rows = rows.select("feature", "part", "time", "gtype", "v", whole.alias("whole"), F.when(wraps, -1).otherwise(F.col("run")).alias("run"), F.when(wraps, F.col("nth") - F.col("n")).otherwise(F.col("nth")).alias("nth"))
    runs = rows.groupBy("feature", "part", "time", "gtype", "whole", "run").agg(F.array_sort(F.collect_list(F.struct("nth", "v"))).alias("r"))
    kind = F.when(F.col("gtype").isin("point", "multipoint") | F.col("whole"), F.col("gtype")).when(F.size("r") == 1, "point").otherwise("polyline")
    return runs.select(F.col("feature").alias(key), "part", "time", F.element_at("r", 1)["nth"].alias("piece"), kind.alias("gtype"), F.transform("r", lambda x: x["v"]).alias("line"))


def evolve(features: DataFrame, surfaces: DataFrame, model: DataFrame, times: list[float], begin: float, *, spacing: float = SPACING, key: str = "id", **options) -> DataFrame:
    """(id, time, v, plate_id, active) of the vertices of features (key, gtype, rings) given at the
    time ``begin``, at ``begin`` and all ``times`` before and after it: they are stepped from
    there to older times and to younger ones, each way by :func:`reconstruct_by_topologies`
    (which has the other options).  ``surfaces`` and ``model`` are at all these times."""
    places, names = _places(settled(vertices(spread(features), spacing, key=key)))
    model = settled(model)
    younger = [float(begin), *sorted((float(t) for t in times if t < begin), reverse=True)]
    older = [float(begin), *sorted(float(t) for t in times if t > begin)]
    span = _stepped(places, surfaces, model, younger, **options)
    if len(older) > 1:
        span = span.unionByName(_stepped(places, surfaces, model, older, **options).where(F.col("time") > begin))
    return _named(span, names)


def geometries_at(span: DataFrame, time: float, begin: float, increment: float, slots: int, *, key: str = "id") -> DataFrame:
    """The geometries (as :func:`reassembled`) of a span of vertices at any time inside it."""
    return reassembled(span_at(span, time, begin, increment, slots).withColumn("time", F.lit(float(time))), key=key)


def span_at(span: DataFrame, time: float, begin: float, increment: float, slots: int, *, values: tuple[str, ...] = ()) -> DataFrame:
    """(id, v, values, active) of a span (id, time, v, active, values) at any time inside it: at a
    slot its row; between slots the arc between the two, and values in proportion; from the
    last active slot on what was there.  Nothing outside the span."""
    spark = span.sparkSession
    slot = spark.range(1).select(kinematics.time_slot(F.lit(float(time)), begin, increment, slots).alias("s")).first()["s"]
    if slot is None:
        return span.where("false").select("id", "v", *values, "active")
    older, part = begin - slot["slot"] * increment, float(slot["fraction"])
    at = lambda t: span.where(F.abs(F.col("time") - t) < 1e-9)
    first = at(older)
    if part == 0:
        return first.select("id", "v", *values, "active")
    second = at(older - increment).select("id", F.col("v").alias("_v"), F.col("active").alias("_active"), *(F.col(c).alias(f"_{c}") for c in values))
    both = first.join(second, "id")
    on = F.col("active") & F.col("_active")
    mix = lambda c: F.when(on, F.col(c) + (F.col(f"_{c}") - F.col(c)) * part).otherwise(F.col(c))
    return both.select("id", F.when(on, S.arc_point(F.col("v"), F.col("_v"), F.lit(part))).otherwise(F.col("v")).alias("v"), *(mix(c).alias(c) for c in values), on.alias("active"))


def scalar_span(rates: DataFrame, initial: DataFrame, times: list[float]) -> DataFrame:
    """(id, time, value, active): crustal thickness of points at all times (older first), from
    dilatation rates (id, time, rate, active) over the step that ends there and initial
    values (id, value).  One ordered fold a point; a point that is not active keeps its
    last value."""
    step = {t: (times[i - 1] - t if i else 0.0) for i, t in enumerate(times)}
    dt = F.create_map(*(F.lit(float(x)) for kv in step.items() for x in kv))
    rows = rates.withColumn("dt", F.element_at(dt, F.col("time"))).where("dt is not null")
    by = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("time", "dt", "rate", "active")), asc=False).alias("r")).join(initial, "id")
    grown = lambda acc, x: F.when(x["active"], F.element_at(acc, -1)["value"] * (1 - x["rate"] * x["dt"] / 2) / (1 + x["rate"] * x["dt"] / 2)).otherwise(F.element_at(acc, -1)["value"])
    start = F.array(F.struct(F.lit(None).cast("double").alias("time"), F.col("value").cast("double").alias("value"), F.lit(True).alias("active")))
    fold = F.aggregate("r", start, lambda acc, x: F.concat(acc, F.array(F.struct(x["time"].alias("time"), grown(acc, x).alias("value"), x["active"].alias("active")))))
    return by.select("id", F.explode(F.slice(fold, F.lit(2), F.size("r"))).alias("s")).select("id", "s.time", "s.value", "s.active")


def smooth_near_boundaries(points: DataFrame, polygons: DataFrame, model: DataFrame, delta: float, half_angle: float, *, off: float = 1e-3, key: str = "id") -> DataFrame:
    """Velocities of points (id, time, v) by the polygons that hold them, mixed near outlines:
    at an angle a below ``half_angle`` from the nearest outline, a / half_angle of the
    point's own and the rest of the mean of both sides there.  The other side is looked for
    ``off`` radians off the outline in four directions, then eight, then sixteen."""
    hit = partition.first_hit(points, polygons, key=key).withColumn("plate_id", F.col("hit").cast("long"))
    own = kinematics.point_velocities(hit.drop("hit"), model, delta).where("plate_id is not null")
    shapes = polygons.select(F.col("plate_id").cast("long").alias("_p"), "rings")
    nearest = lambda rings: F.array_min(F.transform(F.flatten(F.transform(rings, S._edges)), lambda e: F.struct(S.point_to_arc(F.col("v"), e["a"], e["b"]).alias("angle"), S.closest_on_arc(F.col("v"), e["a"], e["b"]).alias("at"))))
    near = own.join(shapes, F.col("plate_id") == F.col("_p")).withColumn("_n", nearest(F.col("rings"))).drop("rings", "_p")
    near = near.groupBy(key, "time", "v", "plate_id", "velocity").agg(F.min("_n").alias("_n")).withColumns({"_angle": F.col("_n.angle"), "_at": F.col("_n.at")})
    turns = sorted(range(16), key=lambda k: (0 if k % 4 == 0 else 1 if k % 2 == 0 else 2, k))
    tries = F.posexplode(F.array(*(S.destination(F.col("_at"), F.lit(2 * 3.141592653589793 * k / 16), F.lit(off)) for k in turns)))
    probes = near.where(F.col("_angle") < half_angle).select(key, "time", F.col("plate_id").alias("_own"), F.col("_at").alias("_b"), tries.alias("nth", "v")).withColumn("_key", F.struct(key, "nth"))
    sides = partition.first_hit(probes, polygons, key="_key").where(F.col("hit").isNotNull() & (F.col("hit") != F.col("_own")))
    other = sides.groupBy(key).agg(F.min_by(F.struct(F.col("hit").cast("long").alias("plate"), "_own", "time", F.col("_b").alias("v")), "nth").alias("o"))
    there = other.select(key, "o.plate", "o._own", "o.time", "o.v")
    side = lambda plate, name: kinematics.point_velocities(there.withColumn("plate_id", F.col(plate)), model, delta).select(F.col(key).alias(f"_{name}"), F.col("velocity").alias(name))
    mean = side("plate", "theirs").join(side("_own", "ours"), F.col("_theirs") == F.col("_ours")).select(F.col("_ours").alias("_k"), S.scale(S.add(F.col("theirs"), F.col("ours")), F.lit(0.5)).alias("_mean"))
    out = near.join(mean, F.col(key) == F.col("_k"), "left")
    mixed = kinematics.smoothed(F.col("velocity"), F.col("_mean"), F.col("_angle"), half_angle)
    return out.select(key, "time", "v", "plate_id", F.when(F.col("_mean").isNotNull(), mixed).otherwise(F.col("velocity")).alias("velocity"), F.col("_angle").alias("angle"))
