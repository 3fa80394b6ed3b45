"""Command line: ``python -m driftplane.plans.cli VERB ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..functions import sphere as S
from ..operators import rotation_model as R
from ..sources import registry
from .session import Session

INDETERMINATE = "Indeterminate"


def pole_text(q: F.Column, identity: str = INDETERMINATE) -> F.Column:
    """(lat, lon, angle) as text; the identity as a word or as the north pole."""
    p = Q.to_pole(q)
    return F.when(p.isNotNull(), F.format_string("(%.4f, %.4f, %.4f)", p["lat"], p["lon"], p["angle"])).otherwise(F.lit("(90.0, 0.0, 0.0)" if identity == "pole" else identity))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftplane")
    verbs = p.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("reconstruct")
    one.add_argument("--features", nargs="+", required=True)
    one.add_argument("--rotations", nargs="+", required=True)
    one.add_argument("--time", type=float, default=0.0)
    one.add_argument("--anchor", type=int, default=0)
    one.add_argument("--output", required=True)
    for name in ("equivalent-rotation", "relative-rotation", "stage-rotation"):
        v = verbs.add_parser(name)
        v.add_argument("--rotations", nargs="+", required=True)
        v.add_argument("--anchor", type=int, default=0)
        v.add_argument("--plate", type=int, required=True)
        v.add_argument("--fixed", type=int, default=0)
        v.add_argument("--time", type=float, default=0.0)
        v.add_argument("--time2", type=float, default=0.0)
        v.add_argument("--asymmetry", type=float)
        v.add_argument("--identity", choices=["word", "pole"], default="word")
    assign = verbs.add_parser("assign-plate-ids")
    assign.add_argument("--features", nargs="+", required=True)
    assign.add_argument("--polygons", nargs="+", required=True)
    assign.add_argument("--time", type=float, default=0.0)
    assign.add_argument("--output", required=True)
    conv = verbs.add_parser("convert")
    conv.add_argument("source")
    conv.add_argument("target")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("driftplane").getOrCreate()
    if a.verb == "convert":
        registry.convert(spark, a.source, a.target)
        return a.target
    s = Session(spark, anchor=getattr(a, "anchor", 0), current_time=a.time)
    for path in getattr(a, "rotations", None) or []:
        s.load(path)
    if a.verb == "reconstruct":
        for path in a.features:
            s.load(path)
        back = F.transform("points", lambda r: F.transform(r, lambda p: F.struct(S.lat(p).alias("lat"), S.lon(p).alias("lon"))))
        registry.write(s.reconstruct().withColumn("rings", back).drop("points", "time"), a.output)
        return a.output
    if a.verb == "assign-plate-ids":
        features, polygons = Session(spark), Session(spark)
        for path in a.features:
            features.load(path)
        for path in a.polygons:
            polygons.load(path)
        vectors = F.transform("rings", lambda r: F.transform(r, lambda p: S.from_lat_lon(p["lat"], p["lon"])))
        shapes = polygons.features().where("gtype = 'polygon'").select("plate_id", vectors.alias("rings"), F.monotonically_increasing_id().alias("input_order"), F.lit("static_polygon").alias("kind"))
        first = F.element_at(F.element_at("rings", 1), 1)
        pts = features.features().withColumn("id", F.col("feature_id")).withColumn("v", S.from_lat_lon(first["lat"], first["lon"]))
        out = Session(spark, current_time=a.time).assign_plates(pts, shapes)
        registry.write(out.drop("v", "id", "time"), a.output)
        return a.output
    if a.verb == "equivalent-rotation":
        q = s.model().where(F.col("plate_id") == a.plate).select("q")
    elif a.verb == "relative-rotation":
        q = s.model().where(F.col("plate_id") == a.plate).select(F.col("relative").alias("q"))
    else:
        q = R.stage(s.model({a.time, a.time2}), a.plate, a.fixed, a.time, a.time2, a.asymmetry).select("q")
    row = q.select(pole_text(F.col("q"), "pole" if a.identity == "pole" else INDETERMINATE).alias("t")).first()
    text = row[0] if row else INDETERMINATE
    print(text)
    return text


if __name__ == "__main__":
    main()
