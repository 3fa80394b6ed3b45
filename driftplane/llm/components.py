"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _print(edges: DataFrame) -> tuple:
    """Count and hash of a set of edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, comp) of every end of ``links`` (a, b): the least node that links reach.

    Alternates large stars (each node's larger neighbours are tied to its least neighbour)
    and small stars (so are its smaller ones), which ends in one star a component.  Both are
    a minimum by node and a join, so no neighbourhood is gathered in one row."""
    edges = store.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(limit):
        both = _ways(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "x")
        large = both.join(least, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every pair now has its larger node first
        large = store.keep(large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large")
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(down, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select(F.col("x").alias("u"), F.col("m").alias("v")))
        new = store.keep(small.distinct(), "small")
        same = _print(new) == _print(edges)
        store.drop(large)
        store.drop(edges)
        edges = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
