"""Registered queries that go through files: written to a scratch folder, read back, compared
with SQL over the tables that they were made from; and the text that sinks write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import MODEL_SQL, C, customers, query, r6, rnd, rot_sql, samples, suppliers, table
from .functions import palettes
from .operators import coregistration
from .operators import rotation_model as R
from .plans.session import Session
from .sources import features as X
from .sources import registry, text, vectors


def scratch(spark: SparkSession) -> str:
    """A fresh folder in ``spark.checkpoint.dir``, which a cluster shares; a local one only
    where driver and executors are one process.  Removed when the application ends."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="driftplane-")
    folder = f"{base}/scratch-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def places(spark, d) -> DataFrame:
    """Customers as point features with text, numbers and nulls."""
    p = F.struct(F.col("lat"), F.col("lon"))
    name = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 5 == 0, F.concat(F.lit('a "b" & <c>, |'), F.col("id"))).otherwise(F.concat(F.lit("n"), F.col("id")))
    return customers(spark, d).select("id", F.lit("point").alias("gtype"), F.array(F.array(p)).alias("rings"), name.alias("name"), "plate_id", "begin", "end")


_NAME = "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 'a \"b\" & <c>, |' || id ELSE 'n' || id END"


def box(spark, d) -> DataFrame:
    """Suppliers as boxes of four corners, clockwise on a map."""
    la, lo = F.col("tlat") * 0.5, F.col("tlon") * 0.5
    ring = F.array(*(F.struct((la + a).alias("lat"), (lo + b).alias("lon")) for a, b in ((0, 0), (2, 0), (2, 3), (0, 3))))
    return suppliers(spark, d).select(F.col("target_id").alias("id"), F.lit("polygon").alias("gtype"), F.array(ring).alias("rings"), F.col("s_acctbal").alias("balance"))


_BOXES = "SELECT s_suppkey AS id, s_acctbal AS balance, 4 AS corners, CAST((s_suppkey * 71) % 179 - 89 AS DOUBLE) * 0.5 + 2 AS north, CAST((s_suppkey * 97) % 360 - 180 AS DOUBLE) * 0.5 AS west FROM supplier"


def _boxes(df: DataFrame, key, balance) -> DataFrame:
    ring = F.element_at("rings", 1)
    return df.select(key.alias("id"), balance.alias("balance"), F.size(ring).alias("corners"), F.array_max(F.transform(ring, lambda p: p["lat"])).alias("north"), F.array_min(F.transform(ring, lambda p: p["lon"])).alias("west"))


# --- rotations ------------------------------------------------------------------------------------



@query("rotation_file_round_trip", f"SELECT CAST(moving AS BIGINT) AS moving, CAST(fixed AS BIGINT) AS fixed, time, lat, lon, angle, CAST(seq AS BIGINT) AS seq FROM (SELECT *, t AS time FROM ({MODEL_SQL}) x) y")
def _(spark, d):
    path = scratch(spark) + "/model.rot"
    rows = samples(spark, d).withColumns({"line": F.monotonically_increasing_id(), "comment": F.lit(" a sample")})
    registry.write(rows, path)
    return registry.read(spark, path).select("moving", "fixed", "time", "lat", "lon", "angle", "seq")


@query("rotation_read_errors", "SELECT CASE WHEN c_custkey % 5 IN (1, 2, 3) THEN 'bad' ELSE 'good' END AS kind, CAST(count(*) AS INTEGER) AS lines FROM customer WHERE c_custkey % 7 > 0 GROUP BY 1")
def _(spark, d):
    """Lines that are no poles are kept apart: latitudes that are none, plates about themselves,
    words; empty lines are passed over, and switched-off ones are good."""
    path = scratch(spark) + "/lines"
    k = F.col("c_custkey")
    made = lambda *c: F.concat_ws(" ", *c)
    plate, time = (k % 900 + 1).cast("string"), (k % 200).cast("string")
    line = F.when(k % 7 == 0, "").when(k % 5 == 1, made(plate, time, F.lit("91.0 0.0 5.0 000"))).when(k % 5 == 2, made(plate, time, F.lit("0.0 0.0 1.0"), plate)).when(k % 5 == 3, "not a pole").when(k % 5 == 4, made(F.lit("999"), time, F.lit("0.0 0.0 1.0 999"))).otherwise(made(plate, time, F.lit("10.0 20.0 3.0 000 ! kept")))
    table(spark, d, "customer").select(line.alias("value")).write.text(path)
    good, bad = text.poles(spark, path)
    both = good.select(F.lit("good").alias("kind")).unionByName(bad.select(F.lit("bad").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").cast("int").alias("lines"))


@query("rotation_metadata_file", "SELECT CAST(n_nationkey % 5 * 10 AS DOUBLE) AS time, CAST(101 + n_nationkey // 5 AS INTEGER) AS moving, 0 AS fixed, 'A' AS author, 'n' || n_nationkey AS note FROM nation")
def _(spark, d):
    """Five sequences of nations with their headers and notes, in lines of one file."""
    path = scratch(spark) + "/meta"
    k = F.col("n_nationkey").cast("long")
    plate = (101 + F.floor(k / 5)).cast("string")
    pole = F.concat_ws(" ", plate, (k % 5 * 10).cast("double").cast("string"), F.lit("40.0 30.0"), (k % 5).cast("double").cast("string"), F.lit("000"), F.concat(F.lit('@NOTE"n'), k.cast("string"), F.lit('"')))
    head = F.concat(F.lit('> @MPRS:pid"'), plate, F.lit('"'))
    lines = F.when(k == 0, F.array(F.lit('@AUTHOR"A"'), head, pole)).when(k % 5 == 0, F.array(head, pole)).otherwise(F.array(pole))
    table(spark, d, "nation").select(k.alias("k"), F.explode(lines).alias("value")).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    rows = text.read_metadata_rotations(spark, path)
    return rows.select("time", F.col("moving").cast("int").alias("moving"), F.col("fixed").cast("int").alias("fixed"), F.col("attributes")["AUTHOR"].alias("author"), F.col("attributes")["NOTE"].alias("note"))


@query("inserted_rotation", f"WITH RECURSIVE {rot_sql([20.0, 60.0])} SELECT CAST(seq AS BIGINT) AS seq, time, {', '.join(f'{rnd(c)} AS {c}' for c in 'wxyz')} FROM e WHERE seq = 2")
def _(spark, d):
    """A sample put in at 20 with no adjustment leaves the sequence as it was."""
    more = R.with_adjustment(samples(spark, d), 101, 100, 20.0, 90.0, 0.0, 0.0, 2).where("seq = 2")
    t = spark.createDataFrame([(20.0,), (60.0,)], "time double")
    return R.bracket(R.usable(more), t).select("seq", "time", *(r6(F.col(f"q.{c}")).alias(c) for c in "wxyz"))


@query("session_reconstruction", f"WITH RECURSIVE {rot_sql([0.0, 20.0])}, {C} SELECT time, count(*) AS features, CAST(sum(id) AS BIGINT) AS ids FROM cv JOIN (VALUES (0e0), (20e0)) s(time) ON begin_ >= s.time AND end_ <= s.time GROUP BY 1")
def _(spark, d):
    """A model and features from files, through a session."""
    folder = scratch(spark)
    registry.write(samples(spark, d).withColumns({"line": F.monotonically_increasing_id(), "comment": F.lit("")}), f"{folder}/model.rot")
    s = Session(spark)
    s.load(f"{folder}/model.rot")
    s.add("places", places(spark, d))
    return s.reconstruct(times=[0.0, 20.0]).groupBy("time").agg(F.count("*").alias("features"), F.sum("id").alias("ids"))


# --- features ---------------------------------------------------------------------------------------


@query("xml_round_trip", f"WITH {C} SELECT CAST(id AS VARCHAR) AS feature_id, {_NAME} AS name, plate_id, lat, lon, begin_ AS begin, CAST('infinity' AS DOUBLE) * -1 AS end FROM c")
def _(spark, d):
    path = scratch(spark) + "/f.gpml"
    rows = places(spark, d).withColumns({"feature_id": F.col("id").cast("string"), "feature_type": F.lit("Place"), "end": F.lit(float("-inf"))})
    registry.write(rows, path)
    p = F.element_at(F.element_at("rings", 1), 1)
    return registry.read(spark, path).select("feature_id", "name", "plate_id", p["lat"].alias("lat"), p["lon"].alias("lon"), "begin", "end")


@query("packed_xml_round_trip", "SELECT CAST(s_suppkey AS VARCHAR) AS feature_id, 4 AS corners FROM supplier")
def _(spark, d):
    path = scratch(spark) + "/f.gpmlz"
    nothing = {c: F.lit(None).cast(t) for c, t in (("name", "string"), ("plate_id", "long"), ("begin", "double"), ("end", "double"))}
    registry.write(box(spark, d).withColumns({"feature_id": F.col("id").cast("string"), "feature_type": F.lit("Box"), **nothing}), path)
    return registry.read(spark, path).select("feature_id", F.size(F.element_at("rings", 1)).alias("corners"))


@query("geojson_round_trip", _BOXES)
def _(spark, d):
    path = scratch(spark) + "/f.geojson"
    registry.write(box(spark, d), path)
    return _boxes(registry.read(spark, path), F.col("properties")["id"].cast("long"), F.col("properties")["balance"].cast("double"))


@query("gmt_round_trip", _BOXES)
def _(spark, d):
    path = scratch(spark) + "/f.gmt"
    registry.write(box(spark, d), path)
    return _boxes(registry.read(spark, path), F.variant_get("attributes.id", "$", "long"), F.variant_get("attributes.balance", "$", "double"))


@query("shapefile_round_trip", _BOXES)
def _(spark, d):
    path = scratch(spark) + "/f.shp"
    registry.write(box(spark, d), path)
    back = registry.read(spark, path.removesuffix(".shp") + "_polygon.shp")
    return _boxes(back, F.variant_get("attributes.id", "$", "long"), F.round(F.variant_get("attributes.balance", "$", "double"), 6))


@query("plates_line_round_trip", "SELECT s_suppkey % 900 AS plate_id, CAST(round(CAST((s_suppkey * 71) % 179 - 89 AS DOUBLE) * 0.5, 4) AS DOUBLE) AS lat, 4 AS points FROM supplier")
def _(spark, d):
    path = scratch(spark) + "/f.dat"
    rows = box(spark, d).select((F.col("id") % 900).alias("plate_id"), F.lit("a box").alias("name"), F.lit(100.0).alias("begin"), F.lit(0.0).alias("end"), "rings", "id", F.lit(None).cast("string").alias("feature_type"))
    registry.write(rows, path)
    return registry.read(spark, path).select("plate_id", F.element_at("coordinates", 1)["lat"].alias("lat"), F.size("coordinates").alias("points"))


@query("xy_export", f"WITH {C} SELECT '> ' || plate_id || ' ' || coalesce({_NAME}, '') || chr(10) || printf('%.6f %.6f', lon, lat) AS value FROM c")
def _(spark, d):
    rows = places(spark, d).withColumns({"coordinates": F.element_at("rings", 1), "line": F.col("id")})
    return text.xy_lines(rows).select("value")


@query("export_attributes", f"WITH {C} SELECT plate_id AS PLATEID1, begin_ AS FROMAGE, end_ AS TOAGE, {_NAME} AS NAME, id FROM c")
def _(spark, d):
    return X.export_attributes(places(spark, d).drop("gtype", "rings"))


@query("csv_sink", f"WITH {C}, n AS (SELECT id, {_NAME} AS name, plate_id FROM c) SELECT id || ',' || CASE WHEN name IS NULL THEN 'NaN' WHEN contains(name, '\"') THEN '\"' || replace(name, '\"', '\"\"') || '\"' ELSE name END || ',' || plate_id AS value FROM n")
def _(spark, d):
    return X.to_csv_lines(places(spark, d).select("id", "name", "plate_id"))


@query("csv_by_time", "SELECT time, count(*) AS lines FROM customer, (VALUES (0), (10), (20)) t(time) WHERE c_custkey % 30 >= time GROUP BY 1")
def _(spark, d):
    path = scratch(spark) + "/csv"
    t = spark.createDataFrame([(0,), (10,), (20,)], "time int")
    rows = table(spark, d, "customer").crossJoin(F.broadcast(t)).where(F.col("c_custkey") % 30 >= F.col("time")).select("time", "c_custkey", "c_mktsegment")
    X.write_csv_by_time(rows, path)
    return spark.read.text(path).groupBy("time").agg(F.count("*").alias("lines"))


@query("coreg_cells", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'true' WHEN c_custkey % 3 = 0 THEN 'NaN' ELSE 'false' END AS b, CASE WHEN c_custkey % 5 = 0 THEN 'NaN' ELSE c_mktsegment END AS t FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 2 == 0, True).when(k % 3 == 0, F.lit(None)).otherwise(False).alias("b"), F.when(k % 5 > 0, F.col("c_mktsegment")).alias("t"))
    return coregistration.as_cells(rows)


_CONFIG = ["# target, filter, attribute, reducer", "coast, Region_of_Interest(500), AGE, MEAN", "coast, Region_of_Interest(1000), DISTANCE, min", "ridge, seed, NAME, VOTE, shapefile", "", "ignored, Region_of_Interest(1), X, min"]


@query("coreg_config_rows", "SELECT * FROM (VALUES (0, 'Seed Feature ID', NULL, NULL), (1, 'Seed Valid Time', NULL, NULL), (2, 'coast_AGE_(mean)', 'property', 500e0), (3, 'coast_DISTANCE_(min)', 'distance', 1000e0), (4, 'ridge_NAME_(vote)', 'attribute', NULL)) t(nth, name, mapper, range_km)")
def _(spark, d):
    rows = coregistration.parse_config(_CONFIG)
    made = [(i, n, rows[i - 2].mapper if i > 1 else None, rows[i - 2].range_km if i > 1 else None) for i, n in enumerate(coregistration.header(rows))]
    return spark.createDataFrame(made, "nth int, name string, mapper string, range_km double")


# --- tables in files -----------------------------------------------------------------------------------


def _file(spark, lines: list[str]) -> str:
    path = scratch(spark) + "/file"
    spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, n int").orderBy("n").select("value").coalesce(1).write.text(path)
    return path


@query("palette_file_colours", "SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN 9e0 WHEN c_acctbal > 4000 THEN 8e0 WHEN c_acctbal < 1000 THEN 100 * c_acctbal / 1000 ELSE 100 + 100 * (c_acctbal - 1000) / 3000 END, 3) + 0e0 AS r FROM customer")
def _(spark, d):
    path = _file(spark, ["# a table", "0 0 0 0 1000 100 0 0", "1000 100 0 0 4000 200 0 0", "B 9 9 9", "F 8 8 8", "N 7 7 7"])
    p = text.read_palette(spark, path)
    return table(spark, d, "customer").select("c_custkey", (F.round(palettes.colour(F.col("c_acctbal"), p)["r"], 3) + F.lit(0.0)).alias("r"))


@query("chron_ages", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 2e0 END AS age FROM orders")
def _(spark, d):
    ages = text.read_age_model(spark, _file(spark, ["# chron M1 M2", "C1 0.5 0.6", "C2 2.0 -"])).where("model = 'M1'")
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("C"), F.col("o_orderkey") % 3 + 1).alias("chron"))
    return rows.join(F.broadcast(ages.select("chron", "age")), "chron", "left").select("o_orderkey", "age")


_VGP = "c_custkey % 60 + 1 AS age, c_custkey * 53 % 179 - 89 AS site_lat, c_custkey * 37 % 360 - 180 AS site_lon, c_custkey * 29 % 171 - 85 AS lat, c_custkey * 41 % 360 - 180 AS lon"


@query("pole_file", f"SELECT CAST(age AS DOUBLE) AS age, CAST(site_lat AS DOUBLE) AS site_lat, CAST(site_lon AS DOUBLE) AS site_lon, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM (SELECT c_custkey, {_VGP} FROM customer) x WHERE c_custkey % 10 > 0")
def _(spark, d):
    """A pole a customer, in lines among which every tenth is none."""
    path = scratch(spark) + "/poles"
    c = table(spark, d, "customer").selectExpr("c_custkey", *_VGP.split(", "))
    line = F.when(F.col("c_custkey") % 10 > 0, F.concat_ws(" ", F.lit("9 30.0 5.0"), "age", "site_lat", "site_lon", F.lit("350.0 40.0 3.0 4.0"), "lat", "lon")).otherwise(F.lit("words and no pole"))
    c.select(line.alias("value")).write.text(path)
    return text.read_poles_file(spark, path).select("age", "site_lat", "site_lon", "lat", "lon")


@query("pick_file_round_trip", "SELECT CAST(l_linenumber AS INTEGER) AS segment, l_suppkey % 2 = 1 AS moving, CAST(l_quantity AS DOUBLE) AS lat, count(*) AS picks FROM lineitem GROUP BY 1, 2, 3")
def _(spark, d):
    path = scratch(spark) + "/picks"
    rows = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("line"), (F.col("l_suppkey") % 2 == 1).alias("moving"), F.col("l_linenumber").cast("int").alias("segment"), F.col("l_quantity").cast("double").alias("lat"), F.lit(1.5).alias("lon"), F.lit(5.0).alias("sigma"), F.lit(True).alias("enabled"))
    text.write_lines(vectors.pick_lines(rows), path, parts=True)
    return text.read_picks(spark, path).groupBy("segment", "moving", "lat").agg(F.count("*").alias("picks"))


@query("grid_round_trip", "SELECT CAST(o_orderkey % 36 AS DOUBLE) AS lat, count(*) AS pixels, count(*) FILTER (WHERE o_orderkey % 5 > 0) AS covered, round(sum(o_totalprice) FILTER (WHERE o_orderkey % 5 > 0), 2) AS total FROM orders GROUP BY 1")
def _(spark, d):
    path = scratch(spark) + "/grid"
    k = F.col("o_orderkey")
    px = table(spark, d, "orders").select(F.lit("b").alias("band"), (k % 36).cast("double").alias("lat"), (k % 72).cast("double").alias("lon"), F.col("o_totalprice").alias("value"), F.when(k % 5 == 0, 0.0).otherwise(1.0).alias("coverage"))
    vectors.write_grid(px, path, "b")
    back = X.read_grid(spark, path, "r")
    return back.groupBy("lat").agg(F.count("*").alias("pixels"), F.sum(F.col("coverage").cast("long")).alias("covered"), F.round(F.sum(F.when(F.col("coverage") > 0, F.col("value"))), 2).alias("total"))


@query("velocity_export", f"WITH {C} SELECT printf('%.4f %.4f %.4f %.4f', lon, lat, CASE WHEN id % 4 = 0 THEN 0e0 WHEN id % 4 = 1 THEN 90e0 WHEN id % 4 = 2 THEN 180e0 ELSE 270e0 END, CAST(id AS DOUBLE)) AS value FROM c")
def _(spark, d):
    k = F.col("id")
    rows = customers(spark, d).select("lat", "lon", F.when(k % 4 == 0, -k).when(k % 4 == 2, k).otherwise(0).cast("double").alias("vel_colat"), F.when(k % 4 == 1, k).when(k % 4 == 3, -k).otherwise(0).cast("double").alias("vel_lon"))
    return X.velocity_lines(rows)


@query("deformation_export", f"WITH {C} SELECT value, count(*) AS n FROM (SELECT printf('%.6f %.6f', lat, lon) || ' ' || printf('%.8e', lat / 4) AS value FROM c UNION ALL SELECT DISTINCT '> ' || plate_id FROM c) t GROUP BY 1")
def _(spark, d):
    rows = customers(spark, d).select(F.col("plate_id").alias("feature_id"), F.col("id").alias("point_idx"), "lat", "lon", (F.col("lat") / 4).alias("dilatation"))
    return vectors.deformation_lines(rows, "dilatation").groupBy("value").agg(F.count("*").alias("n"))


@query("format_registry", "SELECT * FROM (VALUES ('a.rot', 'rotation'), ('a.grot', 'rotation'), ('a.gpml', 'feature'), ('a.gpml.gz', 'feature'), ('a.shp', 'feature'), ('a.gmt', 'feature'), ('a.geojson', 'feature'), ('a.dat', 'feature'), ('a.vgp', 'feature'), ('a.xy', 'feature')) t(path, kind)")
def _(spark, d):
    names = ["a.rot", "a.grot", "a.gpml", "a.gpml.gz", "a.shp", "a.gmt", "a.geojson", "a.dat", "a.vgp", "a.xy"]
    return spark.createDataFrame([(n, registry.format_of(n).kind) for n in names], "path string, kind string")


@query("config_section_lines", "SELECT * FROM (VALUES ('a = 1'), ('b = 2')) t(line)")
def _(spark, d):
    found = text.config_section(["[other]", "x", "", "[mine]", "a = 1", "# no", "b = 2", "", "c = 3"], "mine")
    return spark.createDataFrame([(x,) for x in found], "line string")


# --- scripts ---------------------------------------------------------------------------------------------

_MOVED = "SELECT {key} AS id, {extra}{q} FROM {table} p LEFT JOIN rot r ON r.plate_id = {key} % 7 + 100"


def _layer_sql() -> str:
    from .catalog import P, T, named, turn

    q = tuple(f"coalesce(r.{c}, {v})" for c, v in zip("wxyz", ("1e0", "0e0", "0e0", "0e0"), strict=True))
    moved = named(turn(q, ("p.x", "p.y", "p.z")), "xyz")  # type: ignore[arg-type]
    seeds = _MOVED.format(key="p.seed_id", extra="", q=moved, table="pv")
    targets = _MOVED.format(key="p.target_id", extra="s_acctbal, ", q=moved, table="tv")
    km = "acos(greatest(-1e0, least(1e0, sd.x * td.x + sd.y * td.y + sd.z * td.z))) * 6378.137e0"
    return f"""WITH RECURSIVE {rot_sql([60.0])}, {P}, {T}, sd AS ({seeds}), td AS ({targets}),
pr AS (SELECT sd.id, {km} AS km, s_acctbal FROM sd JOIN td ON {km} < 2000e0)
SELECT sd.id AS seed_id, 60e0 AS time, round(min(km), 2) + 0e0 AS km, count(km) AS n, max(s_acctbal) AS most FROM sd LEFT JOIN pr ON pr.id = sd.id GROUP BY sd.id"""


@query("coreg_layer", _layer_sql())
def _(spark, d):
    """A co-registration layer at 60: seeds and targets where they were."""
    from .catalog import parts
    from .plans.scripting import CoregistrationLayer

    s = Session(spark)
    s.rotations["model"] = samples(spark, d)
    seeds = parts(spark, d).select("seed_id", "v", (F.col("seed_id") % 7 + 100).alias("plate_id"))
    targets = suppliers(spark, d).withColumn("plate_id", F.col("target_id") % 7 + 100)
    config = [coregistration.Column_("supplier", "distance", "min", 2000.0, "distance"), coregistration.Column_("supplier", "n", "lookup", 2000.0, "number_in_region"), coregistration.Column_("supplier", "s_acctbal", "max", 2000.0)]
    out = CoregistrationLayer(s, seeds, {"supplier": targets}, config).data(60.0).toDF("seed_id", "time", "km", "n", "most")
    # metres near 0, where the angle's cosine is 1 to the last digits, are noise
    return out.withColumn("km", F.round("km", 2) + F.lit(0.0))


@query("feature_collection_fields", f"WITH {C} SELECT id, {_NAME} AS name, plate_id, begin_ AS begin_time, end_ AS end_time FROM c WHERE id % 2 = 0")
def _(spark, d):
    from .plans.scripting import FeatureCollection

    return FeatureCollection("places", places(spark, d)).where("id % 2 = 0").features("id", "name", "plate_id", "begin_time", "end_time")


@query("topology_sections_info", "SELECT l_orderkey AS topology_id, l_linenumber AS section_index, l_partkey % 50 AS feature_id, l_partkey % 50 % 3 > 0 AS found, CAST(CASE WHEN l_partkey % 50 % 3 > 0 THEN 2 ELSE 0 END AS INTEGER) AS points FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1) x")
def _(spark, d):
    from .functions import sphere as S
    from .plans.scripting import sections_info

    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    sections = one.select(F.col("l_orderkey").alias("topology_id"), F.col("l_linenumber").alias("section_index"), (F.col("p") % 50).alias("feature_id"), F.lit(False).alias("reverse"), F.lit(0.0).alias("time"))
    line = F.array(S.from_lat_lon(F.lit(0.0), F.col("id").cast("double")), S.from_lat_lon(F.lit(1.0), F.col("id").cast("double")))
    geo = spark.range(50).where("id % 3 > 0").select(F.lit(0.0).alias("time"), F.col("id").alias("feature_id"), line.alias("line"))
    return sections_info(sections, geo).select("topology_id", "section_index", "feature_id", "found", "points")
