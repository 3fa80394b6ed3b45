"""Many features are several files, and a file that Spark cannot hand over whole is read as a stream."""

from pyspark.sql import functions as F

from driftplane.sources import features


def _rows(spark, n):
    lone = {c: F.lit(None).cast(t) for c, t in (("name", "string"), ("begin", "double"), ("end", "double"))}
    ring = F.array(F.array(F.struct(F.lit(1.5).alias("lat"), F.col("id").cast("double").alias("lon"))))
    return spark.range(n).select(F.col("id").cast("string").alias("feature_id"), F.lit("Place").alias("feature_type"), F.col("id").alias("plate_id"), F.lit("point").alias("gtype"), ring.alias("rings")).withColumns(lone)


def test_files_are_whole_collections(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(features, "FILE_FEATURES", 10)
    monkeypatch.setattr(features, "WHOLE", 1500)
    for packing, name in (("none", "a.gpml"), ("gzip", "b.gpmlz")):
        features.write_xml(_rows(spark, 95), str(tmp_path / name), compression=packing)
        assert len(list((tmp_path / name).rglob("part-*"))) == 10
        assert features.read_xml_errors(spark, str(tmp_path / name)).count() == 0
        got = features.read_xml(spark, str(tmp_path / name)).collect()
        assert sorted((int(r["feature_id"]), r["plate_id"], r["rings"][0][0]["lon"]) for r in got) == [(i, i, float(i)) for i in range(95)]
