"""Classification by palettes: interval lookup with linear interpolation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slice:
    low: float
    low_colour: tuple[float, float, float]
    high: float
    high_colour: tuple[float, float, float]


@dataclass(frozen=True)
class Palette:
    """Regular slices, or categories (label to colour), with three special colours."""

    slices: tuple[Slice, ...] = ()
    categories: tuple[tuple[str, tuple[float, float, float]], ...] = ()
    background: tuple[float, float, float] | None = None
    foreground: tuple[float, float, float] | None = None
    nan: tuple[float, float, float] | None = None


def _rgb(c: tuple[float, float, float] | None) -> Column:
    if c is None:
        return F.lit(None).cast("struct<r: double, g: double, b: double>")
    return F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(c, "rgb", strict=True)))


def colour(value: Column, p: Palette) -> Column:
    """Colour of a number: background below the first slice, foreground above the last, the
    NaN colour for NaN; null in a gap.  A shared bound belongs to the lower slice."""
    out = F.lit(None).cast("struct<r: double, g: double, b: double>")
    for s in reversed(p.slices):
        t = (value - s.low) / (s.high - s.low) if s.high > s.low else F.lit(0.0)
        mixed = F.struct(*((a + (b - a) * t).alias(n) for a, b, n in zip(s.low_colour, s.high_colour, "rgb", strict=True)))
        out = F.when((value >= s.low) & (value <= s.high), mixed).otherwise(out)
    if p.slices:
        out = F.when(value < p.slices[0].low, _rgb(p.background)).when(value > p.slices[-1].high, _rgb(p.foreground)).otherwise(out)
    return F.when(F.isnan(value), _rgb(p.nan)).otherwise(out)


def category(label: Column, p: Palette) -> Column:
    out = _rgb(p.nan)
    for name, c in reversed(p.categories):
        out = F.when(label == name, _rgb(c)).otherwise(out)
    return out


def interval_value(df: DataFrame, slices: DataFrame, value: str, max_slices: int = 100_000) -> DataFrame:
    """``df`` with ``level``: the value interpolated in a table (low, high, low_value,
    high_value) of disjoint slices; null outside.  The table is counted before broadcast."""
    if slices.limit(max_slices + 1).count() > max_slices:
        raise ValueError(f"more than {max_slices} slices")
    x = F.col(value)
    hit = df.join(F.broadcast(slices), (x >= F.col("low")) & (x < F.col("high")), "left")
    t = (x - F.col("low")) / (F.col("high") - F.col("low"))
    return hit.withColumn("level", F.col("low_value") + (F.col("high_value") - F.col("low_value")) * t).drop("low", "high", "low_value", "high_value")


def modulo_class(plate_id: Column, classes: int) -> Column:
    """Class of a plate by its id modulo a number of classes."""
    return F.pmod(plate_id, F.lit(classes))


def region_of(plate_id: Column) -> Column:
    """Regional group: the leading digit of three-digit plate ids, 0 for shorter ones."""
    s = plate_id.cast("string")
    return F.when(F.length(s) >= 3, F.left(s, F.length(s) - 2).cast("long")).otherwise(F.lit(0).cast("long"))
