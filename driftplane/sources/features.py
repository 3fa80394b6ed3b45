"""Feature collections: XML, GeoJSON, CSV sink, grids and velocity exports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "feature_id string, feature_type string, name string, plate_id long, left_plate long, right_plate long, begin double, end double, gtype string, rings array<array<struct<lat: double, lon: double>>>"
#: Unbounded times are written with these last parts of their addresses.
_FAR = ("distantPast", "distantFuture")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _time(text: str | None) -> float | None:
    if not text:
        return None
    text = text.strip()
    if text.endswith("distantPast"):
        return float("inf")
    if text.endswith("distantFuture"):
        return float("-inf")
    return float(text)


def _numbers(text: str | None) -> list[float]:
    return [float(x) for x in (text or "").split()]


def _pairs(values: list[float]) -> list[dict]:
    """Positions are latitude before longitude."""
    return [{"lat": a, "lon": b} for a, b in zip(values[0::2], values[1::2], strict=True)]


def parse_collection(text: str) -> list[dict]:
    """Features of one XML feature collection."""
    import io

    return list(features_of(io.BytesIO(text.encode("utf-8"))))


def features_of(source) -> Iterator[dict]:
    """Features of an XML feature collection (a file of bytes in UTF-8), as they are read: what is
    held is one feature, not the collection."""
    import xml.etree.ElementTree as ET

    above, inside = [], 0
    for event, e in ET.iterparse(source, ("start", "end"), parser=ET.XMLParser(encoding="utf-8")):
        member = _local(e.tag) == "featureMember"
        if event == "start":
            above.append(e)
            inside += member
            continue
        above.pop()
        inside -= member
        if member and not inside:
            yield from _features(e)
            if above:
                above[-1].remove(e)


def _features(top) -> list[dict]:
    """Features of a featureMember element."""
    out = []
    for member in top.iter():
        if _local(member.tag) != "featureMember":
            continue
        for f in member:
            row = dict.fromkeys(("feature_id", "name", "plate_id", "left_plate", "right_plate", "begin", "end", "gtype"))
            row |= {"feature_type": _local(f.tag), "rings": []}
            for e in f.iter():
                name = _local(e.tag)
                if name == "identity" and not row["feature_id"]:
                    row["feature_id"] = (e.text or "").strip()
                elif name == "name" and row["name"] is None:
                    row["name"] = (e.text or "").strip() or None
                elif name in ("reconstructionPlateId", "leftPlate", "rightPlate"):
                    values = [v.text for v in e.iter() if _local(v.tag) == "value" and (v.text or "").strip()]
                    if values:
                        row[{"reconstructionPlateId": "plate_id", "leftPlate": "left_plate", "rightPlate": "right_plate"}[name]] = int(values[0])
                elif name == "validTime":
                    for side in e.iter():
                        if _local(side.tag) in ("begin", "end"):
                            at = [p.text for p in side.iter() if _local(p.tag) == "timePosition"]
                            row[_local(side.tag)] = _time(at[0]) if at else None
                elif name in ("LineString", "OrientableCurve") and row["gtype"] is None:
                    found = [p for p in e.iter() if _local(p.tag) == "posList"]
                    if found:
                        row["gtype"], row["rings"] = "polyline", [_pairs(_numbers(found[0].text))]
                elif name == "Polygon" and row["gtype"] is None:
                    rings = [_pairs(_numbers(p.text)) for p in e.iter() if _local(p.tag) == "posList"]
                    row["gtype"], row["rings"] = "polygon", [r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in rings]
                elif name == "MultiPoint" and row["gtype"] is None:
                    row["gtype"], row["rings"] = "multipoint", [[q for p in e.iter() if _local(p.tag) == "pos" for q in _pairs(_numbers(p.text))]]
                elif name == "Point" and row["gtype"] is None:
                    row["gtype"], row["rings"] = "point", [[q for p in e.iter() if _local(p.tag) == "pos" for q in _pairs(_numbers(p.text))]]
            out.append(row)
    return out


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Features of native XML files (also gzipped); one task a file, files of over WHOLE bytes
    read as a stream.  A file that is no XML
    fails the read; see :func:`read_xml_errors`."""
    return _per_file(spark, path)[0]


def read_xml_errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, error) of files that could not be parsed."""
    return _per_file(spark, path, permissive=True)[1]


#: Features of one batch that leave a task.
BATCH = 4096
#: Bytes of a file that is handed over whole; Spark cannot hand over two GiB.
WHOLE = 1 << 28
#: Features that a written file has at most.
FILE_FEATURES = 200_000


def _per_file(spark: SparkSession, path: str, permissive: bool = False) -> tuple[DataFrame, DataFrame | None]:
    found = spark.read.format("binaryFile").load(path)
    files = found.where(F.col("length") <= WHOLE).select(F.col("path").alias("file"), "content")
    # the content of these is not read by Spark, but by the task, from the path
    large = found.where(F.col("length") > WHOLE).select(F.col("path").alias("file"), F.lit(None).cast("binary").alias("content"))
    files = files.unionByName(large)

    def opened(batches):
        """(file, its bytes as a stream): nothing is copied or unpacked as a whole."""
        import gzip

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                if content.is_valid:
                    stream = pa.BufferReader(content.as_buffer())
                else:
                    system, name = fs.FileSystem.from_uri(file.as_py().replace("file:///", "/", 1))
                    stream = system.open_input_file(name)
                packed = stream.read(2) == b"\x1f\x8b"
                stream.seek(0)
                yield file.as_py(), gzip.GzipFile(fileobj=stream) if packed else stream

    def run(batches):
        import itertools

        import pyarrow as pa

        text, number = pa.string(), pa.float64()
        point = pa.struct([("lat", number), ("lon", number)])
        plates = [(c, pa.int64()) for c in ("plate_id", "left_plate", "right_plate")]
        schema = pa.schema([*((c, text) for c in ("file", "feature_id", "feature_type", "name")), *plates, ("begin", number), ("end", number), ("gtype", text), ("rings", pa.list_(pa.list_(point)))])
        for file, stream in opened(batches):
            for rows in itertools.batched(features_of(stream), BATCH):
                yield pa.RecordBatch.from_pylist([{"file": file, **r} for r in rows], schema)

    def failed(batches):
        import pyarrow as pa

        for file, stream in opened(batches):
            try:
                for _ in features_of(stream):
                    pass
            except Exception as e:  # noqa: BLE001  any broken file is reported
                yield pa.RecordBatch.from_pylist([{"file": file, "error": str(e)}], pa.schema([("file", pa.string()), ("error", pa.string())]))

    good = files.mapInArrow(run, f"file string, {SCHEMA}")
    return good, files.mapInArrow(failed, "file string, error string") if permissive else None


def to_xml(features: DataFrame, times: str = "urn:times/") -> DataFrame:
    """(value): each feature as a featureMember element, by column expressions.  Unbounded
    times get ``times`` before their name."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    when = lambda c: F.when(c == float("inf"), F.lit(times + _FAR[0])).when(c == float("-inf"), F.lit(times + _FAR[1])).otherwise(c.cast("string"))
    pos = lambda ring: F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["lat"], p["lon"])), " ")
    first = F.element_at("rings", 1)
    closed = lambda ring: F.concat(ring, F.slice(ring, F.lit(1), F.lit(1)))
    rings = F.array_join(F.transform("rings", lambda r, i: F.concat(F.when(i == 0, "<gml:exterior>").otherwise("<gml:interior>"), F.lit("<gml:LinearRing><gml:posList>"), pos(closed(r)), F.lit("</gml:posList></gml:LinearRing>"), F.when(i == 0, "</gml:exterior>").otherwise("</gml:interior>"))), "")
    geometry = (
        F.when(F.col("gtype") == "point", F.concat(F.lit("<gml:Point><gml:pos>"), pos(first), F.lit("</gml:pos></gml:Point>")))
        .when(F.col("gtype") == "multipoint", F.concat(F.lit("<gml:MultiPoint>"), F.array_join(F.transform(first, lambda p: F.concat(F.lit("<gml:pointMember><gml:Point><gml:pos>"), F.concat_ws(" ", p["lat"], p["lon"]), F.lit("</gml:pos></gml:Point></gml:pointMember>"))), ""), F.lit("</gml:MultiPoint>")))
        .when(F.col("gtype") == "polygon", F.concat(F.lit("<gml:Polygon>"), rings, F.lit("</gml:Polygon>")))
        .otherwise(F.concat(F.lit("<gml:LineString><gml:posList>"), pos(first), F.lit("</gml:posList></gml:LineString>")))
    )
    tag = F.concat(F.lit("f:"), F.col("feature_type"))
    plate = F.when(F.col("plate_id").isNotNull(), F.concat(F.lit("<f:reconstructionPlateId><f:value>"), F.col("plate_id").cast("string"), F.lit("</f:value></f:reconstructionPlateId>"))).otherwise("")
    valid = F.when(F.col("begin").isNotNull() & F.col("end").isNotNull(), F.concat(F.lit("<gml:validTime><gml:TimePeriod><gml:begin><gml:timePosition>"), when(F.col("begin")), F.lit("</gml:timePosition></gml:begin><gml:end><gml:timePosition>"), when(F.col("end")), F.lit("</gml:timePosition></gml:end></gml:TimePeriod></gml:validTime>"))).otherwise("")
    body = F.concat(F.lit("<f:identity>"), esc(F.coalesce("feature_id", F.lit(""))), F.lit("</f:identity>"), F.when(F.col("name").isNotNull(), F.concat(F.lit("<gml:name>"), esc(F.col("name")), F.lit("</gml:name>"))).otherwise(""), plate, valid, geometry)
    return features.select(F.concat(F.lit("<gml:featureMember><"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit("></gml:featureMember>")).alias("value"))


def write_xml(features: DataFrame, path: str, namespace: str = "urn:features", times: str = "urn:times/", compression: str = "none") -> None:
    """A folder of files of at most about FILE_FEATURES features, each a whole collection (few
    features are one file).  The namespace is the address of whatever reader it is written for."""
    spark = features.sparkSession
    head = f'<f:FeatureCollection xmlns:f="{namespace}" xmlns:gml="http://www.opengis.net/gml">'
    files = max(1, -(-features.count() // FILE_FEATURES))
    deal = F.pmod(F.xxhash64("value"), F.lit(files)).cast("int")
    rows = to_xml(features, times).select("value", F.lit(1).alias("k"), deal.alias("f"))
    ends = spark.createDataFrame([(head, 0), ("</f:FeatureCollection>", 2)], "value string, k int").crossJoin(spark.range(files).select(F.col("id").cast("int").alias("f")))
    # in order of k within a file, so that each begins and ends as a collection
    one = rows.unionByName(ends)
    if files == 1:
        out = one.coalesce(1).sortWithinPartitions("k", "value").select("value").write
    else:
        out = one.repartition(files, "f").sortWithinPartitions("f", "k", "value").select("value", "f").write.partitionBy("f")
    out.mode("overwrite").option("compression", compression).text(path)


_GEOJSON = "type string, features array<struct<type: string, id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections with their properties as a map."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", _GEOJSON).alias("c"))
    f = whole.select("file", F.posexplode("c.features").alias("nth", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    pair = lambda p: F.struct(F.get(p, 1).alias("lat"), F.get(p, 0).alias("lon"))
    line = lambda a: F.transform(a, pair)
    rings = (
        F.when(kind == "Point", F.array(F.array(pair(F.from_json(text, "array<double>")))))
        .when(kind.isin("MultiPoint", "LineString"), F.array(line(F.from_json(text, "array<array<double>>"))))
        .when(kind == "Polygon", F.transform(F.from_json(text, "array<array<array<double>>>"), lambda r: F.slice(line(r), F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))))
    )
    gtype = F.lower(F.when(kind == "LineString", "polyline").otherwise(kind))
    return f.select("file", "nth", F.col("f.id").alias("feature_id"), F.col("f.properties").alias("properties"), gtype.alias("gtype"), rings.alias("rings"))


def to_geojson(features: DataFrame, *properties: str) -> DataFrame:
    """(value): each feature as a GeoJSON feature object."""
    pair = lambda p: F.array(p["lon"], p["lat"])
    ring = lambda r: F.transform(r, pair)
    closed = lambda r: F.concat(ring(r), F.slice(ring(r), F.lit(1), F.lit(1)))
    first = F.element_at("rings", 1)
    g = F.col("gtype")
    coordinates = F.when(g == "point", F.to_json(pair(F.element_at(first, 1)))).when(g == "polygon", F.to_json(F.transform("rings", closed))).otherwise(F.to_json(ring(first)))
    kind = F.when(g == "point", "Point").when(g == "multipoint", "MultiPoint").when(g == "polygon", "Polygon").otherwise("LineString")
    props = F.to_json(F.struct(*properties)) if properties else F.lit("{}")
    return features.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}")).alias("value"))


def export_attributes(features: DataFrame) -> DataFrame:
    """The attribute columns of vector exports."""
    names = {"plate_id": "PLATEID1", "begin": "FROMAGE", "end": "TOAGE", "name": "NAME", "feature_type": "TYPE", "feature_id": "FEATURE_ID", "left_plate": "L_PLATE", "right_plate": "R_PLATE"}
    return features.select(*(F.col(c).alias(n) for c, n in names.items() if c in features.columns), *(c for c in features.columns if c not in names))


def csv_cell(c: Column, sep: str = ",") -> Column:
    """A cell quoted where it has the separator, a quote, a line break, or outer spaces."""
    needs = c.contains(sep) | c.contains('"') | c.contains("\n") | c.contains("\r") | c.startswith(" ") | c.endswith(" ")
    return F.when(needs, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def to_csv_lines(df: DataFrame, sep: str = ",") -> DataFrame:
    """(value): rows as delimited text; nulls are "NaN"."""
    return df.select(F.concat_ws(sep, *(csv_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NaN")), sep) for c in df.columns)).alias("value"))


def write_csv_by_time(df: DataFrame, path: str, time: str = "time", sep: str = ",") -> None:
    """A folder a time, so that all times are one job."""
    rest = [c for c in df.columns if c != time]
    df.select(time, F.concat_ws(sep, *(csv_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NaN")), sep) for c in rest)).alias("value")).write.mode("overwrite").partitionBy(time).text(path)


def read_grid(spark: SparkSession, path: str, raster_id: str, band: str = "band_1", level: int = 0) -> DataFrame:
    """Pixels of a longitude, latitude, value text grid; NaN pixels have no coverage."""
    rows = spark.read.schema("lon double, lat double, value double").option("sep", " ").csv(path)
    return rows.select(F.lit(raster_id).alias("raster_id"), F.lit(band).alias("band"), F.lit(level).alias("level"), "lat", "lon", "value", F.when(F.col("value").isNull() | F.isnan("value"), 0.0).otherwise(1.0).alias("coverage"))


def velocity_lines(df: DataFrame, style: str = "xy") -> DataFrame:
    """(value) of (lat, lon, vel_colat, vel_lon): longitude-latitude rows with an arrow's
    azimuth and length, or colatitude components as mantle codes read them."""
    if style == "xy":
        az = F.pmod(F.degrees(F.atan2(F.col("vel_lon"), -F.col("vel_colat"))), F.lit(360.0))
        return df.select(F.format_string("%.4f %.4f %.4f %.4f", "lon", "lat", az, F.sqrt(F.col("vel_lon") ** 2 + F.col("vel_colat") ** 2)).alias("value"))
    return df.select(F.format_string("%.6e %.6e", "vel_colat", "vel_lon").alias("value"))
