"""Of what is equal but for rounding, the query takes what its SQL takes."""

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from driftplane import catalog
from driftplane import catalog_more as M
from driftplane.functions import sphere as S
from driftplane.operators import proximity


def test_nearer_end_where_angles_round_to_one(spark, tmp_path):
    pq.write_table(pa.table({"c_custkey": pa.array([43056, 46188], pa.int64())}), f"{tmp_path}/customer.parquet")
    assert oracle.compare(spark, str(tmp_path), catalog.QUERIES["closest_point_on_arc"], catalog.ORACLES["closest_point_on_arc"]) == ""


def test_seed_on_an_edge_but_for_rounding(spark):
    """Seed 5978 is on the edge of target 634, and SQL finds it 4e-13 km beside it."""
    sf = "/root/testdata/sf0.1"
    seed = M.parts(spark, sf).where("seed_id = 5978").select("seed_id", F.lit("point").alias("gtype"), F.array(F.array("v")).alias("rings"))
    target = M.shaped(spark, sf, "polygon").where("target_id in (29, 634)").select("target_id", "gtype", "rings")
    got = dict(proximity.pairs_within(seed, target, 1500.0, left_key="seed_id", right_key="target_id").select("target_id", "dist_km").collect())
    assert got[29] == 0 and 0 < got[634] < 1e-9


def test_area_of_a_triangle_is_its_formula(spark):
    sf = "/root/testdata/sf0.1"
    rows = M.shaped(spark, sf, "polygon").limit(200).select(S.polygon_area(F.col("rings")), F.abs(S.triangle_area(*(F.col("rings")[0][i] for i in range(3))))).collect()
    assert all(a == b for a, b in rows)
