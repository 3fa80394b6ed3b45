"""Views that scripts use: collections, co-registration layers and topologies, by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coregistration, reconstruct, topology
from .session import Session

#: Columns of a feature by the names that scripts ask for.
FIELDS = {"feature_id": "feature_id", "feature_type": "feature_type", "name": "name", "plate_id": "plate_id", "begin_time": "begin", "end_time": "end"}


@dataclass
class FeatureCollection:
    """A table of features by name."""

    name: str
    table: DataFrame

    def size(self) -> int:
        return self.table.count()

    def features(self, *fields: str) -> DataFrame:
        """The features, or some fields of them; a field that the table lacks is null, and
        ``valid_time`` is the struct of its two ends."""
        if not fields:
            return self.table
        have = set(self.table.columns)
        of = lambda f: F.struct(of("begin_time").alias("begin"), of("end_time").alias("end")) if f == "valid_time" else F.col(FIELDS[f]) if FIELDS.get(f) in have else F.col(f) if f in have else F.lit(None)
        return self.table.select(*(of(f).alias(f) for f in fields))

    def where(self, condition) -> FeatureCollection:
        return FeatureCollection(self.name, self.table.where(condition))


def collections(session: Session) -> list[FeatureCollection]:
    """The feature collections of a session, in the order they were loaded."""
    return [FeatureCollection(n, df) for n, df in session.collections.items()]


@dataclass
class CoregistrationLayer:
    """Seeds and targets (present-day points or geometries with plate ids) and a configuration,
    evaluated at any time."""

    session: Session
    seeds: DataFrame
    targets: dict[str, DataFrame]
    config: list[coregistration.Column_] = field(default_factory=list)
    seed: str = "seed_id"

    def associations(self) -> list[str]:
        """The output columns, one for each configuration row."""
        return [r.name for r in self.config]

    def _at(self, df: DataFrame, time: float) -> DataFrame:
        """Alive rows where they were at a time; without a plate they stay."""
        rows = df.withColumn("time", F.lit(float(time)))
        if {"begin", "end"} <= set(df.columns):
            rows = rows.where(reconstruct.valid_at(F.col("time"), F.col("begin"), F.col("end")))
        if "plate_id" not in df.columns:
            return rows.drop("time")
        model = self.session.model([time])
        shape = {"point": None, "rings": "rings"} if "rings" in df.columns else {"point": "v"}
        return reconstruct.by_plate(rows, model, **shape).drop("time")

    def data(self, time: float) -> DataFrame:
        """A row a seed: its id, the time, and the configuration's columns."""
        targets = {n: self._at(df, time) for n, df in self.targets.items()}
        out = coregistration.coregister(self._at(self.seeds, time), targets, self.config, seed=self.seed)
        head = coregistration.header(self.config)
        return out.select(F.col(self.seed).alias(head[0]), F.lit(float(time)).alias(head[1]), *(F.col(f"`{n}`") for n in self.associations()))

    def over(self, times: list[float]) -> DataFrame:
        """All times as one table."""
        out = self.data(times[0])
        for t in times[1:]:
            out = out.unionByName(self.data(t))
        return out


def sections_info(sections: DataFrame, geometries: DataFrame) -> DataFrame:
    """(time, topology_id, section_index, feature_id, reverse, found, points): the sections of
    topologies, whether each has a geometry at its time, and how many points."""
    found = topology.resolve_sections(sections, geometries).select("time", F.col("topology_id").alias("_t"), F.col("section_index").alias("_s"), F.size("line").alias("points"))
    out = sections.join(found.withColumnRenamed("time", "_time"), (F.col("topology_id") == F.col("_t")) & (F.col("section_index") == F.col("_s")) & (F.col("time") == F.col("_time")), "left")
    return out.select("time", "topology_id", "section_index", "feature_id", "reverse", F.col("points").isNotNull().alias("found"), F.coalesce("points", F.lit(0)).alias("points"))


__all__ = ["CoregistrationLayer", "FeatureCollection", "collections", "sections_info"]
