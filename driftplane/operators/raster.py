"""Rasters as pixel rows (raster_id, band, level, lat, lon, value, coverage)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..functions import sphere as S
from . import coregistration, partition, proximity, shared
from . import rotation_model as R


def statistics(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_dev"))


def moments(value: Column, weight: Column, about: Column | float = 0.0) -> dict[str, Column]:
    """Weighted mean and population deviation from sums that add up across tasks.  The sums
    are taken ``about`` a value near the mean, or large values would cancel."""
    x = value - about
    s0, s1, s2 = F.sum(weight), F.sum(weight * x), F.sum(weight * x * x)
    mean = s1 / s0
    return {"mean": F.when(s0 > 0, F.max(F.lit(about) if isinstance(about, float) else about) + mean), "std_dev": F.when(s0 > 0, F.sqrt(F.greatest(s2 / s0 - mean * mean, F.lit(0.0))))}


def _places(px: DataFrame) -> DataFrame:
    """Pixels (v, value, weight) as sums of each place: what :func:`region_statistics` needs."""
    middle = px.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("_middle"))  # one row
    x, w = F.col("value") - F.col("_middle"), F.col("weight")
    return px.join(F.broadcast(middle)).groupBy("v").agg(F.min("value").alias("_min"), F.max("value").alias("_max"), F.sum("weight").alias("_s0"), F.sum(w * x).alias("_s1"), F.sum(w * x * x).alias("_s2"), F.count("*").alias("_n"), F.max("_middle").alias("_middle"))


def _regions(sites: DataFrame, places: DataFrame, range_km: float, fill_polygons: bool) -> DataFrame:
    """(_s, columns of places) of the places in each site's region: a cap about a point, a band
    about lines and outlines, and, if asked, the interior of polygons."""
    if "rings" not in sites.columns:
        return coregistration.within(sites, places, range_km, seed="_s")
    closed = F.transform("rings", lambda r: F.concat(r, F.slice(r, F.lit(1), F.lit(1))))
    outline = (F.col("gtype") == "polygon") & F.lit(not fill_polygons)
    shapes = sites.select("_s", F.when(outline, "polyline").otherwise(F.col("gtype")).alias("gtype"), F.when(outline, closed).otherwise(F.col("rings")).alias("rings"))
    spots = places.select(F.col("v").alias("_at"), F.lit("point").alias("gtype"), F.array(F.array("v")).alias("rings"))
    found = proximity.pairs_within(shapes, spots, range_km, left_key="_s", right_key="_at").drop("dist_km")
    return found.join(places, F.col("_at") == F.col("v")).drop("_at", "v")


def region_statistics(seeds: DataFrame, pixels: DataFrame, range_km: float, *, seed: str = "seed_id", level: int | None = None, fill_polygons: bool = True) -> DataFrame:
    """Min, max, mean and deviation of the pixels in each seed's region; pixels weigh by
    coverage and area; empty (null) where none has coverage.  Seeds are points (``v``) or
    geometries (gtype, rings).  Pixels of one place are summed first, and seeds of one place
    or shape are a site."""
    px = pixels if level is None else pixels.where(F.col("level") == level)
    px = px.where(F.coalesce(F.col("coverage"), F.lit(1.0)) > 0).select(S.from_lat_lon("lat", "lon").alias("v"), "value", (F.coalesce(F.col("coverage"), F.lit(1.0)) * F.cos(F.radians("lat"))).alias("weight"))
    named, sites = coregistration.seed_sites(seeds, seed)
    pairs = _regions(sites, shared.settled(_places(px)), range_km, fill_polygons)
    mean = F.sum("_s1") / F.nullif(F.sum("_s0"), F.lit(0.0))
    std_dev = F.sqrt(F.greatest(F.sum("_s2") / F.nullif(F.sum("_s0"), F.lit(0.0)) - mean * mean, F.lit(0.0)))
    found = pairs.groupBy("_s").agg(F.min("_min").alias("min"), F.max("_max").alias("max"), (F.max("_middle") + mean).alias("mean"), std_dev.alias("std_dev"), F.sum("_n").alias("pixels"))
    return named.join(found, "_s", "left").drop("_s")


@dataclass(frozen=True)
class RasterRow:
    """One row of a configuration over a raster band."""

    reducer: str
    range_km: float
    level: int = 0
    fill_polygons: bool = True

    @property
    def name(self) -> str:
        return f"{self.reducer}_{self.range_km:g}km"


def coregister_raster(seeds: DataFrame, pixels: DataFrame, rows: list[RasterRow], *, seed: str = "seed_id") -> DataFrame:
    """One row a seed with a column for each configuration row.  All rows read the raster at
    the finest level that any of them asks for; rows of one region share its join."""
    for r in rows:
        if r.reducer not in ("min", "max", "mean", "std_dev") or not r.range_km > 0:
            raise ValueError(f"no result is defined for {r}")
    out = seeds.select(seed).distinct()
    level = min(r.level for r in rows)
    for km, fill in dict.fromkeys((r.range_km, r.fill_polygons) for r in rows):
        mine = [r for r in rows if (r.range_km, r.fill_polygons) == (km, fill)]
        found = region_statistics(seeds, pixels, km, seed=seed, level=level, fill_polygons=fill)
        out = out.join(found.select(seed, *(F.col(r.reducer).alias(r.name) for r in mine)), seed, "left")
    return out.select(seed, *(r.name for r in rows))


def coarser(pixels: DataFrame, rows: str = "row", cols: str = "col") -> DataFrame:
    """The next level of a pyramid: 2 x 2 blocks averaged by coverage."""
    w = F.coalesce(F.col("coverage"), F.lit(1.0))
    return pixels.groupBy("raster_id", "band", (F.col("level") + 1).alias("level"), F.floor(F.col(rows) / 2).alias(rows), F.floor(F.col(cols) / 2).alias(cols)).agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"), F.avg(w).alias("coverage"))


def age_masked(pixels: DataFrame, ages: DataFrame, time: float, *keys: str) -> DataFrame:
    """Pixels whose age grid says they exist at a time (age >= t)."""
    return pixels.join(ages.select(*keys, F.col("value").alias("_age")), list(keys)).where(F.col("_age") >= time).drop("_age")


def reconstructed(pixels: DataFrame, polygons: DataFrame, rot: DataFrame, time: float, step: float = 1.0) -> DataFrame:
    """(row, col, value): pixels moved with the static polygon that holds them, regridded."""
    px = pixels.withColumn("v", S.from_lat_lon("lat", "lon")).withColumn("id", F.struct("lat", "lon"))
    moved = partition.first_hit(px, partition.with_priority(polygons)).where("hit is not null").withColumn("plate_id", F.col("hit")).withColumn("time", F.lit(float(time)))
    moved = R.lookup(moved, rot, out="_q").withColumn("v", Q.rotate(F.col("_q"), F.col("v")))
    return moved.groupBy(F.floor(S.lat(F.col("v")) / step).alias("row"), F.floor(S.lon(F.col("v")) / step).alias("col")).agg(F.avg("value").alias("value"))


def band_at(rasters: DataFrame, time: float, band: str) -> DataFrame:
    """The band of the raster whose time window (begin older, end younger) holds a time."""
    return rasters.where((F.col("band") == band) & (F.col("begin") >= time) & (F.col("end") <= time))


def scalar_field_summary(points: DataFrame) -> DataFrame:
    """Statistics of a field (lat, lon, depth, value) and of its gradient with depth."""
    from pyspark.sql import Window

    w = Window.partitionBy("lat", "lon").orderBy("depth")
    g = points.withColumn("gradient", (F.lead("value").over(w) - F.col("value")) / (F.lead("depth").over(w) - F.col("depth")))
    aggs = lambda c: [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std_dev")]
    return g.agg(*aggs("value"), *aggs("gradient"))


def area_sample(points: DataFrame, degrees: float, per_bin: int, order: str) -> DataFrame:
    """At most ``per_bin`` points of each bin of roughly equal area (a sampling operator)."""
    row = F.floor((F.col("lat") + 90) / degrees)
    width = degrees / F.greatest(F.cos(F.radians((row + 0.5) * degrees - 90)), F.lit(0.01))
    binned = points.withColumn("bin", F.struct(row.alias("row"), F.floor((F.col("lon") + 180) / width).alias("col")))
    from pyspark.sql import Window

    return binned.withColumn("_r", F.row_number().over(Window.partitionBy("bin").orderBy(order))).where(F.col("_r") <= per_bin).drop("_r", "bin")
