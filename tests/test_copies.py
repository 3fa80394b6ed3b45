"""Points of one place and polygons of one shape are tested once."""

from pyspark.sql import functions as F

from driftplane.functions import sphere as S
from driftplane.operators import partition


def test_copies_of_points_and_polygons_are_tested_once(spark, monkeypatch):
    points = spark.range(60).select("id", S.from_lat_lon((F.col("id") % 6).cast("double"), (F.col("id") % 6).cast("double")).alias("v"))
    ring = lambda s: F.array(*(S.from_lat_lon(F.lit(-1.0) * a + s, F.lit(1.0) * b + s) for a, b in ((1.5, -1.5), (1.5, 1.5), (-1.5, 1.5), (-1.5, -1.5))))
    polygons = spark.range(20).select(F.col("id").alias("plate_id"), F.struct("id").alias("priority"), F.array(ring((F.col("id") % 4).cast("double"))).alias("rings"))
    plain = sorted(tuple(r) for r in partition.hits(points, polygons).select("id", "hit", "priority").collect())
    seen = []
    in_cells = partition._in_cells
    monkeypatch.setattr(partition, "_in_cells", lambda p: seen.append(p.count()) or in_cells(p))
    found = partition.hits(points, polygons, copies=True)
    assert found.columns == ["id", "v", "hit", "priority"]
    assert sorted(tuple(r) for r in found.select("id", "hit", "priority").collect()) == plain and len(plain) > 100
    assert seen == [4]
