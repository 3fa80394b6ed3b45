"""Blocks of distances against brute force, and that co-registration of points makes no rows of pairs."""

import math

import pytest
from pyspark.sql import functions as F

from driftplane.functions import sphere as S
from driftplane.operators import coregistration as K
from driftplane.operators import sweep


def _tables(spark):
    seeds = spark.range(60).select(F.col("id").alias("seed_id"), S.from_lat_lon(F.col("id") * 29 % 179 - 89, F.col("id") * 41 % 360 - 180).alias("v"))
    x = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 11 == 0, F.lit(float("nan"))).otherwise((F.col("id") * 13 % 17 - 8).cast("double"))
    targets = spark.range(90).select(F.col("id").alias("target_id"), S.from_lat_lon(F.col("id") * 71 % 179 - 89, F.col("id") * 97 % 360 - 180).alias("v"), x.alias("x"))
    return seeds, targets


def _key(x):
    return (1, 0.0) if math.isnan(x) else (0, x)


@pytest.mark.parametrize("rows", [7, 8192])
def test_points_are_met_in_blocks(spark, monkeypatch, rows):
    seeds, targets = _tables(spark)
    monkeypatch.setattr(sweep, "ROWS", rows)

    def never(*a, **k):
        raise AssertionError("a row a pair")

    monkeypatch.setattr(K, "within", never)
    config = [K.Column_("t", "x", r, 3000.0 + 500 * i) for i, r in enumerate(("min", "max", "median"))]
    config += [K.Column_("t", "x", "percentile", 4000.0, percent=90.0), K.Column_("t", "n", "lookup", 3000.0, "number_in_region"), K.Column_("t", "km", "min", 4000.0, "distance"), K.Column_("t", "far", "max", 4000.0, "distance"), K.Column_("t", "p", "lookup", 3000.0, "presence"), K.Column_("t", "close", "min", 500.0, "distance")]
    got = {r[0]: list(r)[1:] for r in K.coregister(seeds, {"t": targets}, config).collect()}
    place = lambda v: (v["x"], v["y"], v["z"])
    right = [(place(r["v"]), r["x"]) for r in targets.collect()]
    assert len(got) == 60
    for r in seeds.collect():
        a = place(r["v"])
        km = [(math.acos(max(-1.0, min(1.0, sum(p * q for p, q in zip(a, b, strict=True))))) * S.EQUATORIAL_RADIUS, x) for b, x in right]
        of = lambda reach: sorted((x for d, x in km if d < reach and x is not None), key=_key)  # noqa: E731,B023
        lists = of(3000.0), of(3500.0), of(4000.0)
        want = [lists[0][0] if lists[0] else None, lists[1][-1] if lists[1] else None, lists[2][len(lists[2]) // 2] if lists[2] else None, lists[2][max(1, math.ceil(len(lists[2]) * 0.9)) - 1] if lists[2] else None]
        n, near = sum(d < 3000 for d, _ in km), [d for d, _ in km if d < 4000]
        want += [n, min(near, default=None), max(near, default=None), n > 0, min((d for d, _ in km if d < 500), default=None)]
        for x, y in zip(got[r["seed_id"]], want, strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9, nan_ok=True)), (r["seed_id"], got[r["seed_id"]], want)
