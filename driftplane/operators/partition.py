"""Partitioning by polygons and plate assignment.

Points meet polygons in cells of space: a polygon is in the cells that its bounding circle
can touch, of about the circle's own size, so small faces and whole plates are found by one
equi-join each level.  It, and the polygons
themselves, are broadcast when their corners are counted to be few, otherwise joined by
shuffle.  A bounding circle rejects most pairs before the exact test.  Of the polygons that
hold a point, the one of highest priority takes it.  Lines and polygons are cut exactly where
they cross the polygons' outlines; what one polygon leaves goes on to the next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..functions import sphere as S
from . import mesh, shared
from . import rotation_model as R

#: Kinds of partitioning geometry, first served first.
KINDS = ("rigid_block", "network", "boundary", "static_polygon")


def with_priority(polygons: DataFrame, by: str = "plate_id") -> DataFrame:
    """Adds ``priority`` (lower is served first): by kind, then plate id or area, descending,
    then input order."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.coalesce(F.col("kind"), F.lit("static_polygon")))
    size = -F.col("plate_id").cast("double") if by == "plate_id" else -S.polygon_area(F.col("rings"))
    return polygons.withColumn("priority", F.struct(kind.alias("kind"), size.alias("size"), F.col("input_order").cast("long").alias("nth")))


#: Edge of the cubes in which arcs are cut.
CUBE = 0.25
#: Corners of polygons that are broadcast at most, and levels of cells that are kept apart.
FEW_CORNERS, LEVELS = 2_000_000, 6


def _in_cells(polygons: DataFrame) -> tuple[DataFrame, list[int]]:
    """Polygons (hit, priority, _rings, _centre, _cos), a row for each cell (_level, _cell) that
    they touch, eight at most: cells are as large as the polygon's bounding circle.  And the
    levels in use; beyond LEVELS of them, small polygons go to the next larger one."""
    circle = S.bounding_circle(F.element_at("rings", 1))
    p = polygons.select(F.col("plate_id").alias("hit"), "priority", F.col("rings").alias("_rings"), F.explode(F.array(circle)).alias("_b")).withColumns({"_centre": F.col("_b.centre"), "_cos": F.col("_b.cos_radius")}).drop("_b")
    # a circle of over a quarter turn says nothing of the edges: everywhere
    chord = F.when(F.col("_cos") < 0, 3.0).otherwise(F.sqrt(F.greatest(2 - 2 * F.col("_cos"), F.lit(0.0)))) + 1e-9
    p = mesh.once(p, _chord=chord).withColumn("_level", mesh.level(2 * F.col("_chord")))
    used = mesh.levels(p)
    if len(used) > LEVELS:
        used = used[::-1][:: -(-len(used) // LEVELS)][::-1]
        p = p.withColumn("_level", F.array_min(F.filter(F.array(*map(F.lit, used)), lambda x: x >= F.col("_level"))))
    low, high = ([F.col("_centre")[c] + s * F.col("_chord") for c in "xyz"] for s in (-1, 1))
    return p.withColumn("_cell", F.explode(mesh.cells(low, high, F.col("_level")))).drop("_chord"), used


def _cell(at: int | Column) -> Column:
    return mesh.cell([F.col("v")[c] for c in "xyz"], F.lit(at) if isinstance(at, int) else at)


def _corners(polygons: DataFrame, rings: str = "rings") -> int:
    return polygons.agg(F.sum(F.size(F.flatten(rings)))).first()[0] or 0


def _near() -> Column:
    return (F.col("_cos") < 0) | (S.dot(F.col("v"), F.col("_centre")) >= F.col("_cos") - 1e-9)


def hits(points: DataFrame, polygons: DataFrame, *, few: int = FEW_CORNERS, copies: bool = False, test=S.point_in_polygon) -> DataFrame:
    """(point columns, polygon plate_id as ``hit``, priority) of every point in a polygon.

    ``copies``: many points have one place, or polygons one shape; places and shapes are tested
    once, and their points and polygons joined to what is found.  ``test``: whether a point is in
    rings, of those whose bounding circle holds it."""
    if copies:
        shape = F.xxhash64("rings")
        shapes = polygons.select(shape.alias("plate_id"), "rings").dropDuplicates(["plate_id"]).withColumn("priority", F.lit(0))
        met = shared.settled(hits(shared.settled(points.select("v").distinct()), shared.settled(shapes), few=few, test=test).select("v", F.col("hit").alias("_shape")))
        named = polygons.select(F.col("plate_id").alias("hit"), "priority", shape.alias("_shape"))
        return points.join(met, "v").join(named, "_shape").select(*points.columns, "hit", "priority")
    side = F.broadcast if _corners(polygons) <= few else (lambda x: x)
    indexed, used = _in_cells(polygons)
    index = indexed.select(F.xxhash64("hit", "priority", "_rings").alias("_k"), F.col("_level").alias("_in_level"), F.col("_cell").alias("_in_cell"), "_centre", "_cos")
    shapes = polygons.select(F.col("plate_id").alias("hit"), "priority", F.col("rings").alias("_rings")).withColumn("_k2", F.xxhash64("hit", "priority", "_rings"))
    rows = points.withColumn("_of_level", F.explode(F.array(*map(F.lit, used or [0])))).withColumn("_of_cell", _cell(F.col("_of_level")))
    near = rows.join(side(index), (F.col("_of_level") == F.col("_in_level")) & (F.col("_of_cell") == F.col("_in_cell"))).where(_near()).drop("_of_level", "_of_cell", "_in_level", "_in_cell", "_centre", "_cos")
    found = near.join(side(shapes), F.col("_k") == F.col("_k2")).where(test(F.col("v"), F.col("_rings")))
    return found.drop("_k", "_k2", "_rings")


def first_hit(points: DataFrame, polygons: DataFrame, *, key: str = "id", few: int = FEW_CORNERS) -> DataFrame:
    """Each point with the plate of the first polygon that holds it; null if none does.

    Where the polygons of all cells are few, each cell's are one broadcast list a level, and
    points are only spread over all tasks."""
    indexed, used = _in_cells(polygons)
    if _corners(indexed, "_rings") <= few:
        one = F.struct("priority", "hit", "_rings", "_centre", "_cos")
        lists = indexed.groupBy("_level", "_cell").agg(F.array_sort(F.collect_list(one)).alias("_list"))
        test = lambda x: ((x["_cos"] < 0) | (S.dot(F.col("v"), x["_centre"]) >= x["_cos"] - 1e-9)) & S.point_in_polygon(F.col("v"), x["_rings"])
        # the first of a cell that holds: later ones are not tested once one is found
        kinds = dict(indexed.dtypes)
        none = F.lit(None).cast(f"struct<priority: {kinds['priority']}, hit: {kinds['hit']}>")
        step = lambda acc, x: F.when(acc.isNotNull(), acc).when(test(x), F.struct(x["priority"].alias("priority"), x["hit"].alias("hit")))
        rows, names = shared.spread(points), []
        for at in used:
            of = lists.where(F.col("_level") == at).select(F.col("_cell").alias("_in_cell"), "_list")
            rows = rows.withColumn("_of_cell", _cell(at)).join(F.broadcast(of), F.col("_of_cell") == F.col("_in_cell"), "left")
            names.append(f"_h{len(names)}")
            rows = rows.withColumn(names[-1], F.aggregate(F.coalesce("_list", F.slice("_list", 1, 0)), none, step)).drop("_of_cell", "_in_cell", "_list")
        best = F.array_min(F.array(*names))["hit"] if names else F.lit(None).cast(kinds["hit"])
        return rows.withColumn("hit", best).drop(*names)
    best = hits(points, polygons, few=few).groupBy(key).agg(F.min_by("hit", "priority").alias("hit"))
    return points.join(best, key, "left")


def outside(points: DataFrame, polygons: DataFrame, *, key: str = "id", **options) -> DataFrame:
    """Points in no polygon."""
    return first_hit(points, polygons, key=key, **options).where("hit is null").drop("hit")


def most_overlapping(pieces: DataFrame, *, feature: str = "feature_id", plate: str = "hit", size: str = "size", order: str = "nth") -> DataFrame:
    """(feature, hit): the plate with most of each feature; of equals, the first met.

    ``size`` is arc length, or 1 a point."""
    total = pieces.groupBy(feature, plate).agg(F.sum(size).alias("_s"), F.min(order).alias("_o"))
    return total.groupBy(feature).agg(F.max_by(plate, F.struct(F.col("_s"), (-F.col("_o")).alias("o"))).alias(plate))


def assign_plates(features: DataFrame, polygons: DataFrame, rot: DataFrame | None = None, *, key: str = "id", respect_valid_time: bool = True, **options) -> DataFrame:
    """Points (id, v, begin, end, plate_id, time) with the plate of the polygon that holds them
    at ``time``; those not alive then, or in no polygon, keep theirs.  With rotations the
    point is also brought back to the present by its new plate."""
    from .reconstruct import valid_at

    alive = valid_at(F.col("time"), F.col("begin"), F.col("end")) if respect_valid_time else F.lit(True)
    found = first_hit(features.where(alive), polygons, key=key, **options).select(key, F.col("hit").alias("_hit"))
    out = features.join(found, key, "left").withColumn("plate_id", F.coalesce(F.col("_hit").cast("long"), F.col("plate_id").cast("long")))
    if rot is not None:
        out = R.lookup(out, rot, out="_q").withColumn("v", F.when(F.col("_hit").isNotNull(), Q.rotate(Q.conjugate(F.col("_q")), F.col("v"))).otherwise(F.col("v"))).drop("_q")
    return out.drop("_hit")


def assign_poles(poles: DataFrame, polygons: DataFrame, rot: DataFrame, *, key: str = "id", **options) -> DataFrame:
    """Geomagnetic poles (id, site, v, time, plate_id, begin, end): the plate that holds the
    sampling *site* takes the pole, and both are brought back to the present by it.  A pole
    whose site is in no polygon, or that is not alive, keeps its plate and place."""
    from .reconstruct import valid_at

    alive = valid_at(F.col("time"), F.col("begin"), F.col("end"))
    found = first_hit(poles.where(alive).select(key, F.col("site").alias("v")), polygons, key=key, **options).select(key, F.col("hit").alias("_hit"))
    out = poles.join(found, key, "left").withColumn("plate_id", F.coalesce(F.col("_hit").cast("long"), F.col("plate_id").cast("long")))
    out = R.lookup(out, rot, out="_q")
    back = lambda c: F.when(F.col("_hit").isNotNull(), Q.rotate(Q.conjugate(F.col("_q")), F.col(c))).otherwise(F.col(c))
    return out.withColumns({"v": back("v"), "site": back("site")}).drop("_q", "_hit")


_RINGS = "array<array<struct<x: double, y: double, z: double>>>"


def _in_cubes(polygons: DataFrame, cell: float) -> DataFrame:
    """Polygons (hit, priority, rings, centre, cos), a row for each cube ``c`` that they touch."""
    circle = S.bounding_circle(F.element_at("rings", 1))
    p = polygons.select(F.col("plate_id").alias("hit"), "priority", "rings", circle.alias("_b")).select("hit", "priority", F.col("rings").alias("_rings"), F.col("_b.centre").alias("_centre"), F.col("_b.cos_radius").alias("_cos"))
    n = int(math.ceil(1 / cell))
    steps = F.sequence(F.lit(-n), F.lit(n))  # a coordinate of 1 is in the last cube
    reach = cell * math.sqrt(3) / 2
    cubes = F.flatten(F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.transform(steps, lambda k: F.struct(i.alias("i"), j.alias("j"), k.alias("k")))))))
    middle = lambda x: (x + 0.5) * cell
    square = lambda c, v: sum((middle(c[k]) - v[a]) ** 2 for k, a in zip("ijk", "xyz", strict=True))
    # a circle of over a quarter turn says nothing of the edges: everywhere
    chord = F.when(F.col("_cos") < 0, 3.0).otherwise(F.sqrt(F.greatest(2 - 2 * F.col("_cos"), F.lit(0.0))))
    skin = F.filter(cubes, lambda c: F.abs(F.sqrt(sum(middle(c[k]) ** 2 for k in "ijk")) - 1) <= reach)
    spark = polygons.sparkSession
    grid = spark.range(1).select(F.explode(skin).alias("_cube"))  # a few hundred cubes, whatever the input
    return p.join(F.broadcast(grid), F.sqrt(square(F.col("_cube"), F.col("_centre"))) <= chord + reach + 1e-9)


def _overlaps(features: DataFrame, polygons: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, polygons): the polygons, in order of priority, that may touch each feature."""
    from . import proximity

    length = cell / 2
    arcs = features.select(key, F.explode(proximity.arcs(F.col("gtype"), F.col("rings"))).alias("e"))
    at = F.explode(F.array_distinct(F.transform(S.tessellate(F.col("e.a"), F.col("e.b"), length), lambda p: S.cell(p, cell))))
    # an arc between two of its points may pass a cube's corner: the circle is wider by that
    wide = _in_cubes(polygons, cell).select("hit", "priority", F.col("_rings").alias("rings"), F.col("_cube").alias("c"))
    near = F.array(*map(F.lit, (-1, 0, 1)))
    grown = F.flatten(F.flatten(F.transform(near, lambda i: F.transform(near, lambda j: F.transform(near, lambda k: F.struct((F.col("c.i") + i).alias("i"), (F.col("c.j") + j).alias("j"), (F.col("c.k") + k).alias("k")))))))
    wide = wide.withColumn("n", F.xxhash64("hit", "priority", "rings"))
    cubes = wide.select("n", F.explode(grown).alias("c")).distinct()
    pairs = arcs.select(key, at.alias("_c")).distinct().join(cubes, F.col("_c") == F.col("c")).select(key, "n").distinct()
    shapes = wide.select("n", "hit", "priority", "rings").dropDuplicates(["n"])
    one = F.struct("priority", "hit", F.col("rings").alias("rings"))
    return pairs.join(shapes, "n").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["hit"].alias("hit"), x["rings"].alias("rings"))).alias("polygons"))


def partition_geometries(features: DataFrame, polygons: DataFrame, *, key: str = "id", cell: float = CUBE) -> DataFrame:
    """(key, nth, hit, gtype, rings, size): the parts, in order along them, of geometries (key, gtype, rings) that the
    polygons (plate_id, priority, rings) take in turn, and what none takes (hit null).  Lines
    and outlines are cut at the very crossings; a polygon that is cut becomes lines.  ``size``
    is arc length for lines, the number of points for points.

    Geometries of one shape are cut once, and the parts joined to all of them.  Points are met a
    row each, and are put together again, so a large multipoint is no task."""
    spots = F.coalesce(F.col("gtype").isin("point", "multipoint"), F.lit(False))
    found = {r[0] for r in features.select(spots).distinct().collect()}  # two values at most
    out = None
    if True in found:
        points = features.where(spots).select(key, "gtype", F.posexplode(F.flatten("rings")).alias("_nth", "v"))
        one = points.select(F.struct(key, "gtype", "_nth", "v").alias("_of"), F.lit("point").alias("gtype"), F.array(F.array("v")).alias("rings"))
        # a polygon is told by its priority too: plates may have several
        named = polygons.withColumn("plate_id", F.struct("plate_id", "priority"))
        taken = _shared_parts(one, named, "_of", cell).select("_of.*", F.col("hit").alias("_by"))
        sets = taken.groupBy(key, "gtype", "_by").agg(F.array_sort(F.collect_list(F.struct("_nth", "v"))).alias("_p"))
        order = Window.partitionBy(key, "gtype").orderBy(F.col("_by").isNull(), "_by.priority")
        ring = F.transform("_p", lambda x: x["v"])
        out = sets.select(key, (F.row_number().over(order) - 1).alias("nth"), F.col("_by.plate_id").alias("hit"), "gtype", F.array(ring).alias("rings"), F.size("_p").cast("double").alias("size"))
    if False in found or out is None:
        rest = _shared_parts(features.where(~spots), polygons, key, cell)
        out = rest if out is None else out.unionByName(rest)
    return out


def _shared_parts(features: DataFrame, polygons: DataFrame, key: str, cell: float) -> DataFrame:
    """:func:`partition_geometries` of each shape, and joined to the features that have it."""
    shape = F.struct(F.xxhash64("gtype", "rings").alias("a"), F.xxhash64(F.lit(1), "rings", "gtype").alias("b"))
    named = shared.spread(features.select(key, "gtype", "rings")).withColumn("_shape", shape)
    shapes = shared.settled(named.select("_shape", "gtype", "rings").dropDuplicates(["_shape"]))
    parts = shared.settled(_parts(shapes, polygons, "_shape", cell))
    return named.select(key, "_shape").join(parts, "_shape").select(key, "nth", "hit", "gtype", "rings", "size")


def _parts(features: DataFrame, polygons: DataFrame, key: str, cell: float) -> DataFrame:
    """:func:`partition_geometries` of geometries that all differ."""
    near = _overlaps(shared.spread(features), polygons, key, cell)
    rows = shared.spread(features.select(key, "gtype", "rings").join(near, key, "left"))
    kinds = {key: features.select(F.col(key)).schema[0].dataType.simpleString(), "hit": polygons.schema["plate_id"].dataType.simpleString()}

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import cutting

        shape = lambda rings: [np.array([[p["x"], p["y"], p["z"]] for p in r]).reshape(-1, 3) for r in rings or []]
        point = pa.struct([(c, pa.float64()) for c in "xyz"])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                shapes = [(p["hit"], shape(p["rings"])) for p in row["polygons"] or []]
                for nth, (hit, kind, parts) in enumerate(cutting.cascade(row["gtype"], shape(row["rings"]), shapes)):
                    size = float(sum(map(len, parts))) if "point" in kind else sum(cutting.length(np.vstack([p, p[:1]]) if kind == "polygon" else p) for p in parts)
                    out.append((row[key], nth, hit, kind, [[{"x": float(a), "y": float(b), "z": float(c)} for a, b, c in p] for p in parts], size))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [batch.schema.field(key).type, pa.int32(), hit_type, pa.string(), pa.list_(pa.list_(point)), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "nth", "hit", "gtype", "rings", "size"])

    from pyspark.sql.pandas.types import to_arrow_type

    hit_type = to_arrow_type(polygons.schema["plate_id"].dataType)
    return rows.mapInArrow(run, f"{key} {kinds[key]}, nth int, hit {kinds['hit']}, gtype string, rings {_RINGS}, size double")


def split_lines(lines: DataFrame, polygons: DataFrame, *, key: str = "id", **options) -> DataFrame:
    """(id, hit, nth, points, size) pieces of polylines, cut where they cross the polygons."""
    rows = lines.select(key, F.lit("polyline").alias("gtype"), F.array("line").alias("rings"))
    return partition_geometries(rows, polygons, key=key, **options).select(key, "hit", "nth", F.element_at("rings", 1).alias("points"), "size")


def partition_features(features: DataFrame, polygons: DataFrame, rot: DataFrame | None = None, *, key: str = "id", take: tuple[str, ...] = ("plate_id",), respect_valid_time: bool = True, **options) -> DataFrame:
    """One clone of each feature (key, time, begin, end, plate_id, gtype, rings, ...) for each
    plate that has a part of it, with the properties ``take`` of that polygon (plate_id,
    conjugate_plate, begin, end: columns of the polygons).  Features that are not alive, and
    parts outside, keep theirs.  With rotations, parts are brought back to the present."""
    from .reconstruct import valid_at

    alive = valid_at(F.col("time"), F.col("begin"), F.col("end")) if respect_valid_time else F.lit(True)
    names = [c for c in ("plate_id", *take) if c in polygons.columns]
    carried = polygons.withColumn("plate_id", F.struct(*dict.fromkeys(names))).withColumn("priority", F.struct("priority", "plate_id"))
    parts = partition_geometries(features.where(alive), carried, key=key, **options)
    merged = parts.groupBy(key, "hit", "gtype").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "rings"))), lambda x: x["rings"])).alias("rings"))
    rest = features.where(~alive).select(key, F.lit(None).cast(parts.schema["hit"].dataType).alias("hit"), "gtype", "rings")
    out = features.drop("gtype", "rings").join(merged.unionByName(rest), key)
    for c in take:
        old = F.col(c) if c in features.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(f"hit.{c}"), old))
    if rot is not None:
        out = R.lookup(out, rot, out="_q").withColumn("rings", F.when(F.col("hit").isNotNull(), Q.rotate_rings(Q.conjugate(F.col("_q")), F.col("rings"))).otherwise(F.col("rings"))).drop("_q")
    return out.drop("hit")
