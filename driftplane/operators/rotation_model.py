"""Rotation model: pole samples, interpolation to times, plate circuits, stage rotations.

Samples are rows (seq, moving, fixed, time, lat, lon, angle, disabled).  A sequence's
samples bracket a time by a window function and are interpolated natively.  The plate
circuit (which edge claims a plate first) is inherently sequential, but it is over the
sequences of one rotation file set: its size does not grow with the data that is
reconstructed.  It is walked on the driver, bounded by ``max_edges``, and the result, one
row a (time, plate), is what joins broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import quaternion as Q
from ..functions import sphere as S

TIME_EPSILON = 1e-9
DISABLED_PLATE = 999
ROTATIONS = StructType([StructField("time", DoubleType()), StructField("plate_id", LongType()), StructField("parent", LongType()), StructField("q", StructType([StructField(c, DoubleType()) for c in "wxyz"])), StructField("relative", StructType([StructField(c, DoubleType()) for c in "wxyz"]))])


def group_sequences(poles: Iterable[tuple[int, float, int]]) -> list[tuple[int, int, int, bool]]:
    """(sequence, moving, fixed, disabled) of each pole (moving, time, fixed) of a file, in
    file order.  A pole joins the sequence of the pole before it, or starts one:

    at an equal time if the one before is enabled and this is no commented-out pole of the
    same fixed plate; at an earlier time always; at a later time if its plates differ.  A
    commented-out pole (plate 999) in a sequence takes that sequence's moving plate."""
    out: list[tuple[int, int, int, bool]] = []
    seq, last = 0, None
    for moving, time, fixed in poles:
        off = moving == DISABLED_PLATE
        joins = False
        if last is not None:
            same = last[0] == moving and last[2] == fixed
            stands_for = off and last[2] == fixed
            if abs(time - last[1]) <= TIME_EPSILON:
                joins = (same and last[3]) or stands_for
            elif time > last[1]:
                joins = stands_for or same
        if not joins:
            seq += 1
        effective = last[0] if joins and off else moving
        out.append((seq, effective, fixed, off))
        last = (effective, time, fixed, off)
    return out


def islands(df: DataFrame, partition: str, order: list[str], same: list[str], out: str = "island") -> DataFrame:
    """Numbers the runs of rows that agree in ``same``, within a partition: gaps and islands
    by ``lag`` and a running sum."""
    w = Window.partitionBy(partition).orderBy(*order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn(out, F.when(first | new, 1).otherwise(0)).withColumn(out, F.sum(out).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def usable(samples: DataFrame) -> DataFrame:
    """Enabled samples of sequences that have at least two of them, and two frames."""
    on = samples.where(~F.coalesce(F.col("disabled"), F.lit(False)) & F.col("moving").isNotNull() & F.col("fixed").isNotNull())
    return on.withColumn("_n", F.count("*").over(Window.partitionBy("seq"))).where("_n >= 2").drop("_n")


def extend_to_distant_past(samples: DataFrame) -> DataFrame:
    """Adds, for each moving plate, its oldest sample again at infinity, in its sequence."""
    w = Window.partitionBy("moving").orderBy(F.col("time").desc(), "seq")
    oldest = samples.withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) & (F.col("time") < float("inf"))).drop("_r")
    return samples.unionByName(oldest.withColumn("time", F.lit(float("inf"))))


def bracket(samples: DataFrame, times: DataFrame) -> DataFrame:
    """Each sequence's interpolated rotation at each time that it covers (both ends count).

    (seq, moving, fixed, time, q).  An exact hit is the sample itself; an interval open to
    the distant past is its younger sample."""
    w = Window.partitionBy("seq").orderBy("time")
    spans = samples.withColumn("q0", Q.from_pole(F.col("lat"), F.col("lon"), F.col("angle")))
    spans = spans.select("seq", "moving", "fixed", F.col("time").alias("t0"), "q0", F.lead("time").over(w).alias("t1"), F.lead("q0").over(w).alias("q1"), F.max("time").over(Window.partitionBy("seq")).alias("oldest"))
    t = F.col("time")
    covered = (t >= F.col("t0") - TIME_EPSILON) & ((t < F.col("t1") - TIME_EPSILON) | (F.col("t1").isNull() & (t <= F.col("t0") + TIME_EPSILON)))
    # spans are a rotation file's: small beside whatever is asked of them
    hit = times.select(F.col("time").cast("double")).distinct().join(F.broadcast(spans), covered)
    exact = F.abs(t - F.col("t0")) <= TIME_EPSILON
    part = (t - F.col("t0")) / (F.col("t1") - F.col("t0"))
    q = F.when(exact | F.col("q1").isNull() | (F.col("t1") == float("inf")), F.col("q0")).otherwise(Q.slerp(F.col("q0"), F.col("q1"), part))
    return hit.select("seq", "moving", "fixed", "time", q.alias("q"))


def _times(a, b):
    return (a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2], a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1], a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0])


def circuit(edges: list[tuple[int, int, int, tuple]], anchor: int) -> list[tuple[int, int, tuple, tuple]]:
    """(plate, parent, total, relative) of every plate reached from the anchor.

    ``edges``: (seq, moving, fixed, rotation), one time.  Later sequences are tried first.
    From the anchor, or after a reversed edge, one incoming edge may be taken backwards;
    outgoing edges are all taken.  The first edge to reach a plate claims it."""
    out_of, into = defaultdict(list), defaultdict(list)
    for seq, moving, fixed, q in sorted(edges, key=lambda e: -e[0]):
        out_of[fixed].append((moving, q))
        into[moving].append((fixed, q))
    found: dict[int, tuple[int, tuple, tuple]] = {}
    stack = [(anchor, (1.0, 0.0, 0.0, 0.0), True)]
    todo: list = []

    def claim(plate: int, parent: int, total: tuple, relative: tuple) -> bool:
        if plate == anchor or plate in found:
            return False
        found[plate] = (parent, total, relative)
        return True

    # an explicit stack of iterators keeps the depth-first order without recursion
    def steps(plate: int, total: tuple, backwards: bool):
        if backwards:
            for fixed, q in into[plate]:
                r = (q[0], -q[1], -q[2], -q[3])
                if claim(fixed, plate, _times(total, r), r):
                    yield fixed, found[fixed][1], True
                    break
        for moving, q in out_of[plate]:
            if claim(moving, plate, _times(total, q), q):
                yield moving, found[moving][1], False

    todo.append(steps(*stack.pop()))
    while todo:
        step = next(todo[-1], None)
        if step is None:
            todo.pop()
        else:
            todo.append(steps(*step))
    return [(p, f[0], f[1], f[2]) for p, f in found.items()]


def rotations(samples: DataFrame, times: Iterable[float] | DataFrame, anchor: int = 0, max_edges: int = 1_000_000) -> DataFrame:
    """(time, plate_id, parent, q, relative): the total rotation of each plate at each time,
    relative to the anchor, whose own rotation is the identity."""
    spark: SparkSession = samples.sparkSession
    asked = times if isinstance(times, DataFrame) else spark.createDataFrame([(float(t),) for t in times], "time double")
    rows = bracket(usable(samples), asked).limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"more than {max_edges} active edges; ask for fewer times at once")
    by_time = defaultdict(list)
    for r in rows:
        by_time[r["time"]].append((r["seq"], r["moving"], r["fixed"], tuple(r["q"])))
    made = []
    for t, edges in by_time.items():
        made.append((t, anchor, None, (1.0, 0.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0)))
        made += [(t, p, parent, q, rel) for p, parent, q, rel in circuit(edges, anchor)]
    return spark.createDataFrame(made, ROTATIONS)


def circuit_paths(rot: DataFrame) -> DataFrame:
    """(time, plate_id, path): the plates from each plate up to the anchor.  The table is one
    row a (time, plate) of a rotation model; its paths are walked by a recursive query."""
    spark = rot.sparkSession
    rot.select("time", "plate_id", "parent").createOrReplaceTempView("_circuit_edges")
    return spark.sql(
        """WITH RECURSIVE up AS (
             SELECT time, plate_id, parent, array(plate_id) AS path FROM _circuit_edges
             UNION ALL
             SELECT u.time, u.plate_id, e.parent, array_append(u.path, u.parent)
             FROM up u JOIN _circuit_edges e ON u.time <=> e.time AND u.parent = e.plate_id
           )
           SELECT time, plate_id, path FROM up WHERE parent IS NULL"""
    )


def lookup(df: DataFrame, rot: DataFrame, plate: str = "plate_id", time: str = "time", out: str = "q", strict: bool = False) -> DataFrame:
    """Adds a plate's rotation.  An unknown plate gets the identity; null if ``strict``."""
    r = F.broadcast(rot.select(F.col("time").alias("__t"), F.col("plate_id").alias("__p"), F.col("q").alias("__q")))
    joined = df.join(r, (F.col(time).cast("double") == F.col("__t")) & (F.col(plate).cast("long") == F.col("__p")), "left")
    return joined.withColumn(out, F.col("__q") if strict else F.coalesce("__q", Q.identity())).drop("__t", "__p", "__q")


def relative(rot: DataFrame, fixed: int) -> DataFrame:
    """(time, plate_id, q) relative to another plate: inverse(fixed) then plate."""
    base = rot.where(F.col("plate_id") == fixed).select("time", F.col("q").alias("_f"))
    return rot.join(F.broadcast(base), "time").select("time", "plate_id", Q.multiply(Q.conjugate(F.col("_f")), F.col("q")).alias("q"))


def stage(rot: DataFrame, moving: int | None, fixed: int, t1: float, t2: float, asymmetry: float | None = None) -> DataFrame:
    """(plate_id, q): the rotation of plates relative to ``fixed`` from t1 to t2.

    With an asymmetry in [-1, 1] the angle is scaled by (1 + asymmetry) / 2."""
    rel = relative(rot, fixed)
    if moving is not None:
        rel = rel.where(F.col("plate_id") == moving)
    a = rel.where(F.abs(F.col("time") - t1) <= TIME_EPSILON).select("plate_id", F.col("q").alias("a"))
    b = rel.where(F.abs(F.col("time") - t2) <= TIME_EPSILON).select("plate_id", F.col("q").alias("b"))
    out = a.join(b, "plate_id").select("plate_id", Q.multiply(F.col("b"), Q.conjugate(F.col("a"))).alias("q"))
    return out if asymmetry is None else out.withColumn("q", scaled(F.col("q"), 0.5 * (1 + asymmetry)))


def scaled(q, factor: float):
    """The rotation about the same axis by a factor of the angle, taken the short way."""
    return S.let(lambda s: F.when(Q.is_identity(s), Q.identity()).otherwise(Q.from_axis(Q.axis(s), Q.angle(s) * factor)), Q.shortest(q))


def about_anchor(q, at_start, at_end):
    """A stage rotation as seen from the anchor: R(end) q inverse(R(start)) of the fixed plate."""
    return Q.multiply(Q.multiply(at_end, q), Q.conjugate(at_start))


def half_stage(left, right):
    """Halfway between two plates: left, then half of (right relative to left)."""
    return S.let(lambda a, b: Q.multiply(a, scaled(Q.multiply(Q.conjugate(a), b), 0.5)), left, right)


def half_stage_folded(model: DataFrame, pairs: DataFrame, begin: float = 0.0, step: float = 10.0) -> DataFrame:
    """Half-stage rotation summed over stages of ``step`` from ``begin`` to each row's time.

    ``pairs``: (left, right, time).  ``model``: :func:`rotations` at all stage times; see
    :func:`stage_times`.  The stages of a row are folded in order, oldest last."""
    r = model.select("time", "plate_id", "q")
    n = F.greatest(F.ceil((F.col("time") - begin) / step - 1e-9), F.lit(0.0)).cast("int")
    ids = pairs.select("left", "right", F.col("time").cast("double")).distinct()
    steps = ids.withColumn("k", F.explode(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array(F.lit(0)))))
    young = F.least(F.lit(begin) + (F.greatest(F.col("k"), F.lit(1)) - 1) * step, F.greatest("time", F.lit(begin)))
    old = F.least(F.lit(begin) + F.col("k") * step, F.col("time"))
    steps = steps.withColumn("t0", young).withColumn("t1", F.greatest(old, young))
    for name, plate, at in (("l0", "left", "t0"), ("r0", "right", "t0"), ("l1", "left", "t1"), ("r1", "right", "t1")):
        steps = lookup(steps, r, plate, at, name)
    rel = lambda a, b: Q.multiply(Q.conjugate(F.col(a)), F.col(b))
    steps = steps.withColumn("s0", rel("l0", "r0")).withColumn("s1", rel("l1", "r1"))
    steps = steps.withColumn("s", Q.multiply(F.col("s1"), Q.conjugate(F.col("s0")))).withColumn("h", scaled(F.col("s"), 0.5))
    folded = steps.groupBy("left", "right", "time").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("hs"))
    total = F.aggregate("hs", Q.identity(), lambda acc, s: Q.multiply(s["h"], acc))
    folded = lookup(folded.withColumn("half", total), r, "left", "time", "l")
    return folded.select("left", "right", "time", Q.multiply(F.col("l"), F.col("half")).alias("q"))


def stage_times(times: Iterable[float], begin: float = 0.0, step: float = 10.0) -> list[float]:
    """All times at which :func:`half_stage_folded` needs rotations."""
    out = {float(begin)}
    for t in times:
        out |= {float(t), *(begin + k * step for k in range(int(np.ceil((t - begin) / step - 1e-9)) + 1) if begin + k * step <= t + 1e-9)}
    return sorted(out)


def pole_table(rot: DataFrame) -> DataFrame:
    """(time, plate_id, parent, lat, lon, angle, x, y, z): total poles as published tables
    list them; the identity is the north pole with no angle."""
    p = rot.withColumn("_p", Q.to_pole(F.col("q")))
    out = p.select("time", "plate_id", "parent", F.coalesce("_p.lat", F.lit(90.0)).alias("lat"), F.coalesce("_p.lon", F.lit(0.0)).alias("lon"), F.coalesce("_p.angle", F.lit(0.0)).alias("angle"))
    v = S.from_lat_lon("lat", "lon")
    return out.withColumns({"x": v["x"], "y": v["y"], "z": v["z"]})


def with_adjustment(samples: DataFrame, moving: int, fixed: int, time: float, lat: float, lon: float, angle: float, seq: int) -> DataFrame:
    """A sequence with one more sample, its own rotation at ``time`` turned by an adjustment;
    a sample already at that time is replaced."""
    spark = samples.sparkSession
    mine = samples.where((F.col("seq") == seq) & (F.col("moving") == moving) & (F.col("fixed") == fixed))
    at = bracket(mine.where(~F.coalesce("disabled", F.lit(False))), spark.createDataFrame([(float(time),)], "time double"))
    turned = at.withColumn("p", Q.to_pole(Q.multiply(Q.from_pole(F.lit(lat), F.lit(lon), F.lit(angle)), F.col("q"))))
    row = turned.select("seq", "moving", "fixed", "time", F.coalesce("p.lat", F.lit(90.0)).alias("lat"), F.coalesce("p.lon", F.lit(0.0)).alias("lon"), F.coalesce("p.angle", F.lit(0.0)).alias("angle"), F.lit(False).alias("disabled"))
    keep = samples.where(~((F.col("seq") == seq) & (F.abs(F.col("time") - time) <= TIME_EPSILON)))
    return keep.unionByName(row, allowMissingColumns=True)


def sequence_summary(samples: DataFrame) -> DataFrame:
    """(seq, moving, fixed, youngest, oldest, samples, disabled) of each sequence."""
    return samples.groupBy("seq", "moving", "fixed").agg(F.min("time").alias("youngest"), F.max("time").alias("oldest"), F.count("*").alias("samples"), F.sum(F.col("disabled").cast("int")).alias("disabled"))
