"""Streams of features.  Rotation models are small static tables, so reconstructing a stream
is a stateless join; rates by plate are windowed aggregates with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reconstruct as _reconstruct


def reconstruct_stream(features: DataFrame, rotations: DataFrame) -> DataFrame:
    """Rows (plate_id, time, v) of a stream, moved to their time; works on batches as well."""
    return _reconstruct.by_plate(features, rotations)


def assign_stream(points: DataFrame, polygons: DataFrame, key: str = "id") -> DataFrame:
    """Points of a stream with every polygon that holds them, and its priority (the first hit
    needs an aggregate; take it downstream by key)."""
    from ..operators import partition

    return partition.hits(points, polygons)


def counts_by_plate(points: DataFrame, event_time: str, window: str, late: str) -> DataFrame:
    """Points by plate and window; events later than ``late`` are left out."""
    return points.withWatermark(event_time, late).groupBy(F.window(event_time, window), "plate_id").agg(F.count("*").alias("points"))


__all__ = ["assign_stream", "counts_by_plate", "reconstruct_stream"]
