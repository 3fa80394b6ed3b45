"""Generated points: uniform coverings and mesh domains, as ranges and column arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sphere as S


def _icosahedron() -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    g = (1 + 5**0.5) / 2
    v = np.array([p for a in (-1, 1) for b in (-g, g) for p in ((0, a, b), (a, b, 0), (b, 0, a))], float)
    v /= np.linalg.norm(v[0])
    near = v @ v.T > 0.4
    faces = [(i, j, k) for i in range(12) for j in range(i + 1, 12) for k in range(j + 1, 12) if near[i, j] and near[j, k] and near[i, k]]
    return v, faces


def rhombi() -> np.ndarray:
    """The 30 faces of a rhombic triacontahedron on the sphere: (30, 4, 3) corners in turn.
    Each is an icosahedron's edge and the middles of the two faces beside it."""
    v, faces = _icosahedron()
    middle = [v[list(f)].sum(0) / np.linalg.norm(v[list(f)].sum(0)) for f in faces]
    out = []
    for i in range(12):
        for j in range(i + 1, 12):
            beside = [m for f, m in zip(faces, middle, strict=True) if i in f and j in f]
            if len(beside) == 2:
                out.append([v[i], beside[0], v[j], beside[1]])
    return np.array(out)


def diamonds(rows: int = 3) -> np.ndarray:
    """12 diamonds of a mantle-code mesh: (12, 4, 3) corners in turn, four a row."""
    at = lambda colat, lon: [np.sin(np.radians(colat)) * np.cos(np.radians(lon)), np.sin(np.radians(colat)) * np.sin(np.radians(lon)), np.cos(np.radians(colat))]
    out = []
    for k in range(4):
        m = 90 * k
        out.append([at(0, 0), at(45, m - 45), at(90, m), at(45, m + 45)])
        out.append([at(45, m + 45), at(90, m), at(135, m + 45), at(90, m + 90)])
        out.append([at(180, 0), at(135, m + 45), at(90, m), at(135, m - 45)])
    return np.array(out)


def _faces(spark: SparkSession, corners: np.ndarray) -> DataFrame:
    names = [f"{c}{i}" for i in range(4) for c in "xyz"]
    return spark.createDataFrame([(i, *map(float, q.ravel())) for i, q in enumerate(corners)], "face int, " + ", ".join(f"{n} double" for n in names))


def _inside(s: Column, t: Column) -> Column:
    """The point at fractions s, t of a face, by its four corners, brought to the sphere."""
    mix = lambda c: (1 - s) * (1 - t) * F.col(f"{c}0") + s * (1 - t) * F.col(f"{c}1") + s * t * F.col(f"{c}2") + (1 - s) * t * F.col(f"{c}3")
    return S.normalise(S.vector(mix("x"), mix("y"), mix("z")))


def uniform_points(spark: SparkSession, level: int, offset: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, face, v): one point a cell of a rhombic triacontahedron halved ``level`` times
    (about 40 degrees apart at level 0); ``offset`` in [0, 1] moves points about in cells."""
    n = 1 << level
    cells = spark.range(30 * n * n).withColumn("face", F.floor(F.col("id") / (n * n)).cast("int"))
    shift = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(1 << 30)) / float(1 << 30) - 0.5) * offset
    s = (F.floor(F.col("id") / n) % n + 0.5 + shift(1)) / n
    t = (F.col("id") % n + 0.5 + shift(2)) / n
    return cells.join(F.broadcast(_faces(spark, rhombi())), "face").select("id", "face", _inside(s, t).alias("v"))


def points_in_polygons(spark: SparkSession, polygons: DataFrame, level: int, **options) -> DataFrame:
    """Uniform points inside polygons, each with the first polygon that holds it."""
    from . import partition

    return partition.first_hit(uniform_points(spark, level, **options), polygons).where("hit is not null")


def in_extent(points: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    lat, lon = S.lat(F.col("v")), F.pmod(S.lon(F.col("v")) - west, F.lit(360.0))
    return points.where((lat >= south) & (lat <= north) & (lon <= east - west))


def mesh_caps(spark: SparkSession, nodes: int) -> DataFrame:
    """(cap, row, col, v): 12 caps of nodes x nodes mesh points, edges included."""
    n = nodes * nodes
    cells = spark.range(12 * n).withColumn("face", F.floor(F.col("id") / n).cast("int")).withColumn("row", F.floor(F.col("id") / nodes) % nodes).withColumn("col", F.col("id") % nodes)
    at = lambda c: F.col(c) / (nodes - 1)
    return cells.join(F.broadcast(_faces(spark, diamonds())), "face").select(F.col("face").alias("cap"), "row", "col", _inside(at("row"), at("col")).alias("v"))


def mesh_icosahedral(spark: SparkSession, nodes: int) -> DataFrame:
    """(diamond, row, col, v): ten diamonds of two icosahedron faces each."""
    v, faces = _icosahedron()
    top = int(np.argmax(v[:, 2] + 1e-6 * v[:, 0]))
    ring = sorted((i for i in range(12) if v[i] @ v[top] > 0.4 and i != top), key=lambda i: float(_turn(v[top], v[i])))
    bottom = int(np.argmin(v @ v[top]))
    quads = []
    for k, i in enumerate(ring):
        j = ring[(k + 1) % 5]
        low = next(m for m in range(12) if m not in (top, bottom, *ring) and v[m] @ v[i] > 0.4 and v[m] @ v[j] > 0.4)
        after = next(m for m in range(12) if m not in (top, bottom, low, *ring) and v[m] @ v[j] > 0.4 and v[m] @ v[low] > 0.4)
        quads += [[v[top], v[i], v[low], v[j]], [v[j], v[low], v[bottom], v[after]]]
    n = nodes * nodes
    cells = spark.range(10 * n).withColumn("face", F.floor(F.col("id") / n).cast("int")).withColumn("row", F.floor(F.col("id") / nodes) % nodes).withColumn("col", F.col("id") % nodes)
    at = lambda c: F.col(c) / (nodes - 1)
    return cells.join(F.broadcast(_faces(spark, np.array(quads))), "face").select(F.col("face").alias("diamond"), "row", "col", _inside(at("row"), at("col")).alias("v"))


def _turn(axis: np.ndarray, p: np.ndarray) -> float:
    east = np.cross(axis, [0.123, 0.456, 0.789])
    east /= np.linalg.norm(east)
    return float(np.arctan2(p @ np.cross(axis, east), p @ east))


def processors(mt: int, nt: int, nd: int) -> int:
    """How many pieces a ten-diamond mesh of mt intervals falls into, nt a side and nd
    diamonds together."""
    return (mt // nt) ** 2 * 10 // nd


def lat_lon_grid(spark: SparkSession, step: float) -> DataFrame:
    """(lat, lon, v): cell-cornered grid, both ends included."""
    rows, cols = int(round(180 / step)) + 1, int(round(360 / step)) + 1
    g = spark.range(rows * cols).select((F.floor(F.col("id") / cols) * step - 90).alias("lat"), (F.col("id") % cols * step - 180).alias("lon"))
    return g.withColumn("v", S.from_lat_lon("lat", "lon"))
