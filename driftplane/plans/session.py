"""A session: named tables of features and rotation samples, and queries over them.

Nothing is computed until a result is used; a time series is one job, with time a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sphere as S
from ..operators import coregistration, partition, reconstruct
from ..operators import rotation_model as R
from ..sources import registry


@dataclass
class Session:
    spark: SparkSession
    collections: dict[str, DataFrame] = field(default_factory=dict)
    rotations: dict[str, DataFrame] = field(default_factory=dict)
    current_time: float = 0.0
    anchor: int = 0

    def load(self, path: str, name: str | None = None) -> DataFrame:
        """Reads a file by its extension and registers it as a temporary view."""
        df = registry.read(self.spark, path)
        name = name or path.rstrip("/").rsplit("/", 1)[-1].partition(".")[0]
        kind = self.rotations if registry.format_of(path).kind == "rotation" else self.collections
        kind[name] = df
        df.createOrReplaceTempView(name)
        return df

    def add(self, name: str, df: DataFrame) -> None:
        self.collections[name] = df
        df.createOrReplaceTempView(name)

    def register(self, name: str, f: Callable, returns: str) -> None:
        """A user function usable in SQL."""
        self.spark.udf.register(name, f, returns)

    def samples(self) -> DataFrame:
        """All rotation samples; sequences of later files come after those of earlier ones."""
        out = None
        for i, df in enumerate(self.rotations.values()):
            cols = df.select((F.col("seq") + F.lit(i << 40)).alias("seq"), "moving", "fixed", "time", "lat", "lon", "angle", "disabled")
            out = cols if out is None else out.unionByName(cols)
        if out is None:
            raise ValueError("no rotations are loaded")
        return out

    def model(self, times: Iterable[float] | None = None) -> DataFrame:
        return R.rotations(self.samples(), [self.current_time] if times is None else times, self.anchor)

    def features(self, *names: str) -> DataFrame:
        """Collections as one table (none named: all)."""
        out = None
        for n in names or self.collections:
            df = self.collections[n].withColumn("collection", F.lit(n))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise ValueError("no features are loaded")
        return out

    def reconstruct(self, *names: str, times: Iterable[float] | None = None) -> DataFrame:
        """Features at times, rings as unit vectors."""
        f = self.features(*names).withColumn("points", F.transform("rings", lambda r: F.transform(r, lambda p: S.from_lat_lon(p["lat"], p["lon"]))))
        times = [self.current_time] if times is None else list(times)
        return reconstruct.reconstruct(f, self.samples(), times, self.anchor, point=None, rings="points")

    def coregister(self, seeds: DataFrame, targets: dict[str, DataFrame], config: list[str]) -> DataFrame:
        """A configuration in text, over reconstructed seeds and targets."""
        return coregistration.coregister(seeds, targets, coregistration.parse_config(config))

    def assign_plates(self, features: DataFrame, polygons: DataFrame, **options) -> DataFrame:
        at = features if "time" in features.columns else features.withColumn("time", F.lit(self.current_time))
        return partition.assign_plates(at, partition.with_priority(polygons), **options)


def time_series(start: float, end: float, step: float) -> list[float]:
    """From ``start`` to ``end`` (both ends if the step fits), in either direction."""
    if step <= 0:
        raise ValueError("the step is above zero")
    n = int(abs(end - start) / step + 1e-9)
    sign = 1 if end >= start else -1
    return [start + sign * k * step for k in range(n + 1)]
