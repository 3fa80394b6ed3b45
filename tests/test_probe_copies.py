"""Points of one place are weighed once, and each has its weights."""

from pyspark.sql import functions as F

from driftplane.functions import sphere as S
from driftplane.operators import mesh


def test_weights_of_copies(spark, monkeypatch):
    corner = lambda la, lo: S.from_lat_lon(F.lit(float(la)), F.lit(float(lo)))
    centre = corner(0, 0)
    faces = spark.range(1).select(F.lit(1).alias("topology_id"), F.array(corner(-4, -4), corner(-4, 4.5), corner(4, 0)).alias("vertices"), centre.alias("centre"))
    points = spark.range(30).select("id", S.from_lat_lon(F.lit(-1.0), (F.col("id") % 3).cast("double") / 2).alias("v"), F.lit(1).alias("topology_id"))
    seen = []
    in_plane = mesh.once
    monkeypatch.setattr(mesh, "once", lambda df, **c: seen.append(df) or in_plane(df, **c))
    got = mesh.natural_rows(points, faces).groupBy("id", "v").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    assert len(got) == 30 and all(abs(r["w"] - 1) < 1e-9 and r["n"] == 3 for r in got)
    # the table of the points that is worked on has a row a place
    assert [df.count() for df in seen if "_p" in df.columns and "_t" not in df.columns] == [3]
