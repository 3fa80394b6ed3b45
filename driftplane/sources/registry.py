"""Formats by file extension: which can be read and written, and how."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import features, text, vectors


@dataclass(frozen=True)
class Format:
    name: str
    kind: str
    read: Callable[[SparkSession, str], DataFrame] | None = None
    write: Callable[[DataFrame, str], None] | None = None


def _write_lines(to: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, str], None]:
    return lambda df, path: text.write_lines(to(df), path)


def _numbered(df: DataFrame) -> DataFrame:
    """Features as (line, coordinates): line formats write the first ring."""
    out = df if "coordinates" in df.columns else df.withColumn("coordinates", F.element_at("rings", 1))
    return out if "line" in df.columns else out.withColumn("line", F.monotonically_increasing_id())


def _write_geojson(df: DataFrame, path: str) -> None:
    """One collection in one file, a feature a line: sorted and written as a stream."""
    plain = [c for c, t in df.dtypes if t in ("string", "bigint", "int", "double") and c not in ("file", "gtype")]
    rows = features.to_geojson(df, *plain).withColumns({"k": F.lit(1), "n": F.monotonically_increasing_id()})
    comma = F.when(F.row_number().over(Window.orderBy("n")) > 1, F.lit(",")).otherwise("")
    rows = rows.withColumn("value", F.concat(comma, "value"))
    ends = df.sparkSession.createDataFrame([('{"type":"FeatureCollection","features":[', 0, 0), ("]}", 2, 0)], "value string, k int, n long")
    rows.unionByName(ends).orderBy("k", "n").select("value").coalesce(1).write.mode("overwrite").text(path)


def _write_gmt(df: DataFrame, path: str) -> None:
    plain = [c for c, t in df.dtypes if t in ("string", "bigint", "int", "double") and c not in ("file", "gtype", "nth")]
    text.write_lines(vectors.gmt_lines(df, *plain), path)


def _write_packed(df: DataFrame, path: str) -> None:
    features.write_xml(df, path, compression="gzip")


#: Extensions and what they hold.
FORMATS = {
    "gpml": Format("xml features", "feature", features.read_xml, features.write_xml),
    "gpmlz": Format("gzipped xml features", "feature", features.read_xml, _write_packed),
    "gpml.gz": Format("gzipped xml features", "feature", features.read_xml, _write_packed),
    "gsml": Format("geoscience xml", "feature", features.read_xml),
    "rot": Format("rotations", "rotation", text.read_rotations, _write_lines(text.rotation_lines)),
    "grot": Format("rotations with metadata", "rotation", text.read_metadata_rotations, _write_lines(text.rotation_lines)),
    "dat": Format("plates lines", "feature", text.read_plates_lines, _write_lines(lambda d: text.plates_lines(_numbered(d)))),
    "pla": Format("plates lines", "feature", text.read_plates_lines, _write_lines(lambda d: text.plates_lines(_numbered(d)))),
    "geojson": Format("geojson", "feature", features.read_geojson, _write_geojson),
    "json": Format("geojson", "feature", features.read_geojson, _write_geojson),
    "shp": Format("shapefile", "feature", vectors.read_shapefile, vectors.write_shapefile),
    "gmt": Format("gmt lines", "feature", vectors.read_gmt, _write_gmt),
    "xy": Format("xy lines", "feature", None, _write_lines(lambda d: text.xy_lines(_numbered(d)))),
    "vgp": Format("geomagnetic poles", "feature", text.read_poles_file),
}


def format_of(path: str) -> Format:
    """The format of the longest extension that matches."""
    low = path.rstrip("/").lower()
    found = [e for e in FORMATS if low.endswith("." + e)]
    if not found:
        raise ValueError(f"no format is known for {path!r}")
    return FORMATS[max(found, key=len)]


def read(spark: SparkSession, path: str) -> DataFrame:
    f = format_of(path)
    if f.read is None:
        raise ValueError(f"{f.name} can only be written")
    return f.read(spark, path)


def write(df: DataFrame, path: str) -> None:
    f = format_of(path)
    if f.write is None:
        raise ValueError(f"{f.name} can only be read")
    f.write(df, path)


def convert(spark: SparkSession, source: str, target: str) -> None:
    """Reads one format and writes another of its kind."""
    if format_of(source).kind != format_of(target).kind:
        raise ValueError("features and rotations do not convert into each other")
    write(read(spark, source), target)
