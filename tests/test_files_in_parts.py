"""Files that are read and written by many tasks."""

from pyspark.sql import functions as F

from driftplane.sources import text, vectors


def test_pick_files_are_read_in_parts(spark, tmp_path):
    """No task holds a file, and lines have the numbers that a whole read gives."""
    path = str(tmp_path / "picks.txt")
    with open(path, "w") as f:
        f.writelines(f"{1 + i % 2} {i % 9} {i % 90}.5 10.25 5.0\r\n" if i % 13 else "# note\n" for i in range(5000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        got = text.read_picks(spark, path)
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 5
        rows = got.select("line", "moving", "segment", "lat").orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert [tuple(r) for r in rows] == [(i + 1, i % 2 == 1, i % 9, i % 90 + 0.5) for i in range(5000) if i % 13]


def test_pick_files_are_written_in_parts(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select(F.col("id").alias("line"), (F.col("id") % 2 == 0).alias("moving"), (F.col("id") % 5).cast("int").alias("segment"), (F.col("id") / 100).alias("lat"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("sigma"), F.lit(True).alias("enabled"))
    path = str(tmp_path / "many")
    text.write_lines(vectors.pick_lines(rows), path, parts=True)
    assert len(list((tmp_path / "many").glob("part-*"))) > 1
    back = sorted(text.read_picks(spark, path).select("file", "line", "lat").collect())
    assert [r["lat"] for r in back] == [i / 100 for i in range(4000)]
