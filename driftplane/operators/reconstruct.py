"""Reconstruction of features: valid time, rotation lookup, geometry transforms.

Features are rows with plate_id, begin, end (Ma; begin is older) and a geometry: either a
point struct ``v`` or ``rings`` (arrays of points).  Rotations are broadcast: a row a
(time, plate), independent of how many features there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..functions import sphere as S
from . import rotation_model as R
from . import shared


def valid_at(time: Column | float, begin: Column, end: Column) -> Column:
    """Closed at both ends; a missing bound is no bound."""
    t = F.lit(time) if isinstance(time, (int, float)) else time
    known = begin.isNotNull() & end.isNotNull()
    return ~known | ((begin >= t - R.TIME_EPSILON) & (end <= t + R.TIME_EPSILON))


#: Methods, least priority first; where several apply, the last is used.
METHODS = ("BY_PLATE_ID", "HALF_STAGE_ROTATION", "SMALL_CIRCLE", "VIRTUAL_GEOMAGNETIC_POLE", "FLOWLINE", "MOTION_PATH")


def choose_method(applies: dict[str, Column]) -> Column:
    """The applicable method of highest priority; BY_PLATE_ID where none is."""
    out = F.lit("BY_PLATE_ID")
    for name in METHODS:
        if name in applies:
            out = F.when(applies[name], name).otherwise(out)
    return out


def at_times(features: DataFrame, times: DataFrame, ignore_valid_time: bool = False) -> DataFrame:
    """Each feature at each time at which it is alive."""
    crossed = features.crossJoin(F.broadcast(times.select(F.col("time").cast("double"))))
    return crossed if ignore_valid_time else crossed.where(valid_at(F.col("time"), F.col("begin"), F.col("end")))


def by_plate(features: DataFrame, rot: DataFrame, *, point: str | None = "v", rings: str | None = None, reverse: bool = False) -> DataFrame:
    """Rotates the geometry of rows that have a ``time`` to that time, or (``reverse``) from
    that time to the present."""
    df = R.lookup(features, rot, out="_q")
    q = Q.conjugate(F.col("_q")) if reverse else F.col("_q")
    df = df.withColumn("_r", q)
    if point:
        df = df.withColumn(point, Q.rotate(F.col("_r"), F.col(point)))
    if rings:
        df = df.withColumn(rings, Q.rotate_rings(F.col("_r"), F.col(rings)))
    return df.drop("_q", "_r")


def by_half_stage(features: DataFrame, model: DataFrame, begin: float = 0.0, step: float = 10.0) -> DataFrame:
    """Rows (left, right, time, v) moved by the folded half-stage rotation of their plates."""
    q = R.half_stage_folded(model, features, begin, step)
    joined = features.join(q.withColumnRenamed("q", "_q"), ["left", "right", "time"])
    return joined.withColumn("v", Q.rotate(F.col("_q"), F.col("v"))).drop("_q")


def small_circles(features: DataFrame, rot: DataFrame, n: int = 64) -> DataFrame:
    """Rotates the centre ``v``, keeps the radius (degrees), and adds the circle's points."""
    return by_plate(shared.spread(features), rot).withColumn("ring", S.small_circle(F.col("v"), F.radians("radius"), n))


#: When a geomagnetic pole is shown.
ALWAYS, TIME_WINDOW, ABOUT_AGE = "always", "time_window", "about_age"


def geomagnetic_poles(poles: DataFrame, rot: DataFrame, visibility: str = ALWAYS, earliest: float = float("inf"), latest: float = float("-inf"), delta: float = 5.0) -> DataFrame:
    """Rotates pole ``v`` and ``site``; a95, dm, dp and age are carried along."""
    age, t = F.col("age"), F.col("time")
    shown = {ALWAYS: F.lit(True), TIME_WINDOW: (age <= earliest) & (age >= latest), ABOUT_AGE: F.abs(age - t) <= delta}[visibility]
    df = R.lookup(poles.where(shown), rot, out="_q")
    return df.withColumn("v", Q.rotate(F.col("_q"), F.col("v"))).withColumn("site", Q.rotate(F.col("_q"), F.col("site"))).drop("_q")


def flowlines(seeds: DataFrame, model: DataFrame, samples: list[float]) -> DataFrame:
    """Two lines a seed: (..., side, points), for seeds (id, left, right, time, v).

    The stages are the sample times from the row's time on; each is half the stage rotation
    of one plate relative to the other, folded in order from the seed outwards."""
    s = F.array(*[F.lit(float(x)) for x in sorted(samples)])
    inside = (F.col("time") >= F.element_at(s, 1)) & (F.col("time") <= F.element_at(s, -1))
    t = F.array_sort(F.array_union(F.array(F.col("time")), F.filter(s, lambda x: x > F.col("time"))))
    rows = seeds.withColumn("time", F.col("time").cast("double")).where(inside).withColumn("_ts", t)
    rows = rows.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    rows = rows.withColumn("_fix", F.when(F.col("side") == "left", F.col("left")).otherwise(F.col("right"))).withColumn("_mov", F.when(F.col("side") == "left", F.col("right")).otherwise(F.col("left")))
    plain = rows.select("id", "time", "side", "_fix", "_mov", F.posexplode("_ts").alias("k", "t"))
    for name, plate in (("f", "_fix"), ("m", "_mov")):
        plain = R.lookup(plain, model, plate, "t", name)
    plain = plain.withColumn("rel", Q.multiply(Q.conjugate(F.col("f")), F.col("m")))
    by = plain.groupBy("id", "time", "side").agg(F.array_sort(F.collect_list(F.struct("k", "rel"))).alias("rels"))
    n = F.size("rels")
    pairs = F.zip_with(F.slice("rels", F.lit(1), n - 1), F.slice("rels", F.lit(2), n - 1), lambda a, b: Q.multiply(b["rel"], Q.conjugate(a["rel"])))
    by = by.withColumn("stages", pairs).withColumn("halves", F.transform("stages", lambda q: R.scaled(q, 0.5)))
    joined = rows.drop("_ts", "_fix", "_mov").join(by.select("id", "time", "side", "halves"), ["id", "time", "side"])
    points = F.aggregate("halves", F.array(F.col("v")), lambda acc, q: F.concat(acc, F.array(Q.rotate(q, F.element_at(acc, -1)))))
    return joined.withColumn("points", points).drop("halves")


def motion_paths(seeds: DataFrame, model: DataFrame, samples: list[float]) -> DataFrame:
    """(..., points): where a seed on ``plate_id`` was relative to ``reference`` at each sample
    time not younger than the row's time, oldest first, placed by the reference plate at
    that time.  Paths of fewer than two points are left out."""
    s = F.array(*[F.lit(float(x)) for x in sorted(samples)])
    t = F.array_sort(F.array_union(F.array(F.col("time")), F.filter(s, lambda x: x > F.col("time"))))
    inside = (F.col("time") >= F.element_at(s, 1)) & (F.col("time") <= F.element_at(s, -1))
    rows = seeds.withColumn("time", F.col("time").cast("double")).where(inside)
    long = rows.withColumn("t", F.explode(t))
    for name, plate in (("p", "plate_id"), ("r", "reference")):
        long = R.lookup(long, model, plate, "t", name)
    long = long.withColumn("rel", Q.multiply(Q.conjugate(F.col("r")), F.col("p"))).withColumn("at", Q.rotate(F.col("rel"), F.col("v")))
    long = R.lookup(long, model, "reference", "time", "now").withColumn("at", Q.rotate(F.col("now"), F.col("at")))
    by = long.groupBy("id", "time").agg(F.reverse(F.array_sort(F.collect_list(F.struct("t", "at")))).alias("_p"))
    by = by.select("id", "time", F.transform("_p", lambda x: x["at"]).alias("points")).where(F.size("points") >= 2)
    return rows.join(by, ["id", "time"])


def reconstruct(features: DataFrame, samples: DataFrame, times: list[float], anchor: int = 0, **geometry) -> DataFrame:
    """Features at times: the engine's shortest end-to-end query."""
    spark = features.sparkSession
    t = spark.createDataFrame([(float(x),) for x in times], "time double")
    return by_plate(at_times(features, t), R.rotations(samples, times, anchor), **geometry)


def reverse_reconstruct(features: DataFrame, samples: DataFrame, time: float, anchor: int = 0, **geometry) -> DataFrame:
    """Geometries given at ``time`` brought back to the present day."""
    return by_plate(features.withColumn("time", F.lit(float(time))), R.rotations(samples, [time], anchor), reverse=True, **geometry)
