"""What kind of feature a row is, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feature types that are topologies, and those of the rotation model.
TOPOLOGICAL = {"line": ("TopologicalLine",), "boundary": ("TopologicalClosedPlateBoundary", "TopologicalSlabBoundary"), "network": ("TopologicalNetwork",)}
GEOMETRIES = ("point", "multipoint", "polyline", "polygon")


def is_type(*names: str, column: str = "feature_type") -> Column:
    """Whether a feature is of one of the types."""
    return F.coalesce(F.col(column).isin(*names), F.lit(False))


def has_geometry(*kinds: str, column: str = "gtype") -> Column:
    """Whether a feature has a geometry of one of the kinds (of any, if none is named)."""
    return F.coalesce(F.col(column).isin(*(kinds or GEOMETRIES)), F.lit(False))


def is_rotation(fixed: str = "fixed", moving: str = "moving", sequence: str = "samples") -> Column:
    """A rotation sequence: it has both reference frames and samples."""
    return F.col(fixed).isNotNull() & F.col(moving).isNotNull() & F.col(sequence).isNotNull()


def is_topology(kind: str | None = None, column: str = "topology_kind") -> Column:
    """A topology of a kind (line, boundary, network), or of any: by the kind of its geometry."""
    return F.coalesce(F.col(column).isin(*([kind] if kind else TOPOLOGICAL)), F.lit(False))


def topology_kind(column: str = "feature_type") -> Column:
    """The kind of topology that a feature type has; null for others."""
    out = F.lit(None).cast("string")
    for kind, names in TOPOLOGICAL.items():
        out = F.when(F.col(column).isin(*names), kind).otherwise(out)
    return out
