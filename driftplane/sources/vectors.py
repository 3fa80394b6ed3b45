"""Vector files with attribute tables: shapefiles and GMT lines; grids, picks and exports.

Readers take a file a task, as these formats are read from their start.  Attributes become a
map of variants, typed as the file types them."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text

SCHEMA = "nth long, gtype string, rings array<array<struct<lat: double, lon: double>>>, attributes map<string, string>"
Rings = list[list[tuple[float, float]]]

# --- shapefiles: fixed values of the format ------------------------------------------------------

FILE_CODE, VERSION = 9994, 1000
POINT, LINE, POLYGON, MULTIPOINT = 1, 3, 5, 8
KINDS = {POINT: "point", LINE: "polyline", POLYGON: "polygon", MULTIPOINT: "multipoint"}


class Invalid(ValueError):
    """A file that breaks its format."""


def _turning(ring: list[tuple[float, float]]) -> float:
    """Twice the plane area of a (lat, lon) ring; negative if clockwise."""
    return sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def parse_shapes(data: bytes) -> Iterator[tuple[int, str, Rings]]:
    """(record number, kind, (lat, lon) rings) of a .shp file.  Polygons of several outer rings
    come as several; heights and measures are left out; null shapes are skipped."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != FILE_CODE:
        raise Invalid("no shapefile header")
    at = 100
    while at + 8 <= len(data):
        number, words = struct.unpack(">ii", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if len(body) < 2 * words:
            raise Invalid("the last record is cut off")
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == 0:
            continue
        if kind == POINT:
            x, y = struct.unpack("<2d", body[4:20])
            yield number, "point", [[(y, x)]]
        elif kind == MULTIPOINT:
            n = struct.unpack("<i", body[36:40])[0]
            v = struct.unpack(f"<{2 * n}d", body[40 : 40 + 16 * n])
            yield number, "multipoint", [list(zip(v[1::2], v[0::2], strict=True))]
        elif kind in (LINE, POLYGON):
            parts, n = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
            v = struct.unpack(f"<{2 * n}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n])
            points = list(zip(v[1::2], v[0::2], strict=True))
            rings = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            if kind == LINE:
                for r in rings:
                    yield number, "polyline", [r]
                continue
            rings = [r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in rings]
            group: Rings = []
            for r in rings:  # outer rings are clockwise; holes follow theirs
                if group and _turning(r) <= 0:
                    yield number, "polygon", group
                    group = []
                group.append(r)
            yield number, "polygon", group
        else:
            raise Invalid(f"unknown shape type {kind}")


def parse_table(data: bytes) -> list[dict]:
    """Rows of a .dbf file: text, numbers, booleans (None where blank); deleted rows count."""
    if len(data) < 32:
        raise Invalid("no table header")
    n, head, size = struct.unpack("<iHH", data[4:12])
    fields, at = [], 32
    while at < head - 1 and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("utf-8", "replace")
        fields.append((name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    rows = []
    for i in range(n):
        raw, row, lo = data[head + i * size : head + (i + 1) * size], {}, 1
        for name, kind, width, digits in fields:
            cell = raw[lo : lo + width].decode("utf-8", "replace").strip().strip("\0")
            lo += width
            if kind in "NF":
                try:
                    row[name] = None if not cell or set(cell) == {"*"} else float(cell) if digits or kind == "F" else int(cell)
                except ValueError:
                    row[name] = None
            elif kind == "L":
                row[name] = {"T": True, "Y": True, "F": False, "N": False}.get(cell.upper())
            else:
                row[name] = cell or None
        rows.append(row)
    return rows


def _variants(df: DataFrame) -> DataFrame:
    return df.withColumn("attributes", F.transform_values("attributes", lambda _, v: F.try_parse_json(v)))


def _coordinates(rings: Rings) -> list:
    return [[{"lat": float(a), "lon": float(o)} for a, o in r] for r in rings]


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, gtype, rings, attributes) of shapefiles with their tables beside them."""
    base = path[:-4] if path.lower().endswith(".shp") else path.rstrip("/") + "/*"
    files = spark.read.format("binaryFile").load(base + ".shp").select(F.regexp_replace("path", "(?i)[.]shp$", "").alias("file"), F.col("content").alias("shapes"))
    try:
        tables = spark.read.format("binaryFile").load(base + ".dbf").select(F.regexp_replace("path", "(?i)[.]dbf$", "").alias("file"), F.col("content").alias("rows"))
        files = files.join(tables, "file", "left")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = files.withColumn("rows", F.lit(None).cast("binary"))

    def run(frames):
        import pandas as pd

        for frame in frames:
            for file, shapes, rows in zip(frame["file"], frame["shapes"], frame["rows"], strict=True):
                table = parse_table(bytes(rows)) if rows is not None else []
                out = [(file, n, kind, _coordinates(rings), {k: json.dumps(v) for k, v in (table[n - 1] if n <= len(table) else {}).items()}) for n, kind, rings in parse_shapes(bytes(shapes))]
                yield pd.DataFrame(out, columns=["file", "nth", "gtype", "rings", "attributes"])

    return _variants(files.mapInPandas(run, f"file string, {SCHEMA}"))


def shapes_of(kind: str, geometries: list[Rings]) -> tuple[bytes, bytes]:
    """The .shp and .shx files of geometries of one kind."""
    code = {v: k for k, v in KINDS.items()}[kind]
    records, index, at = [], [], 50
    lo, hi = [180.0, 90.0], [-180.0, -90.0]
    for number, rings in enumerate(geometries, 1):
        if kind == "polygon":  # closed; the outer ring clockwise, holes the other way
            rings = [r if (_turning(r) < 0) == (i == 0) else r[::-1] for i, r in enumerate(rings)]
            rings = [[*r, r[0]] for r in rings]
        xy = [(o, a) for r in rings for a, o in r]
        box = [min(x for x, _ in xy), min(y for _, y in xy), max(x for x, _ in xy), max(y for _, y in xy)]
        lo, hi = [min(lo[0], box[0]), min(lo[1], box[1])], [max(hi[0], box[2]), max(hi[1], box[3])]
        flat = [v for p in xy for v in p]
        if kind == "point":
            body = struct.pack("<i2d", code, *xy[0])
        elif kind == "multipoint":
            body = struct.pack(f"<i4di{len(flat)}d", code, *box, len(xy), *flat)
        else:
            starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
            body = struct.pack(f"<i4d2i{len(starts)}i{len(flat)}d", code, *box, len(rings), len(xy), *starts, *flat)
        index.append(struct.pack(">ii", at, len(body) // 2))
        records.append(struct.pack(">ii", number, len(body) // 2) + body)
        at += 4 + len(body) // 2

    def head(size: int) -> bytes:
        return struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", VERSION, code, *lo, *hi, 0, 0, 0, 0)

    body, places = b"".join(records), b"".join(index)
    return head(100 + len(body)) + body, head(100 + len(places)) + places


def table_of(rows: list[dict]) -> bytes:
    """A .dbf file: integers, floats, booleans and text by what the values are."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    fields = []
    for name in names:
        values = [r[name] for r in rows if r.get(name) is not None]
        if values and all(isinstance(v, bool) for v in values):
            fields.append((name, "L", 1, 0, lambda v: "?" if v is None else "T" if v else "F"))
        elif values and all(isinstance(v, int) and not isinstance(v, bool) for v in values):
            fields.append((name, "N", 19, 0, lambda v: "" if v is None else str(v)))
        elif values and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            fields.append((name, "F", 24, 15, lambda v: "" if v is None else repr(float(v))[:24]))
        else:
            width = min(254, max([1, *(len(str(v).encode()) for v in values)]))
            fields.append((name, "C", width, 0, lambda v: "" if v is None else str(v)))
    size = 1 + sum(f[2] for f in fields)
    out = [struct.pack("<B3BiHH20x", 3, 70, 1, 1, len(rows), 32 + 32 * len(fields) + 1, size)]
    out += [name.encode()[:10].ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([width, digits]) + b"\0" * 14 for name, kind, width, digits, _ in fields]
    out.append(b"\r")
    for r in rows:
        out.append(b" ")
        for name, kind, width, _, show in fields:
            cell = show(r.get(name)).encode()[:width]
            out.append(cell.ljust(width) if kind in "CL" else cell.rjust(width))
    return b"".join([*out, b"\x1a"])


def write_shapefile(features: DataFrame, path: str) -> None:
    """Features (gtype, rings, attributes or plain columns) as ``path``_<kind>.shp, .shx and
    .dbf, a set a kind: the format holds one kind and 2 GB a file.  A task writes a kind."""
    plain = [c for c, t in features.dtypes if t in ("string", "bigint", "int", "double", "boolean") and c not in ("file", "gtype", "nth")]
    own = F.to_json(F.struct(*plain)) if plain else F.lit("{}")
    attrs = F.to_json(F.transform_values("attributes", lambda _, v: F.to_json(v) if "variant" in dict(features.dtypes)["attributes"] else v)) if "attributes" in features.columns else F.lit("{}")
    coded = "variant" in dict(features.dtypes).get("attributes", "")
    rows = features.select("gtype", "rings", own.alias("own"), attrs.alias("attrs"))
    stem = path[:-4] if path.lower().endswith(".shp") else path
    stem = stem if "://" in stem else "file://" + stem

    def run(key, rows):
        import pyarrow as pa
        from pyarrow import fs

        table, kind, rings_ = [], key[0].as_py(), rows.column("rings").to_pylist()
        for own_, attrs_ in zip(rows.column("own").to_pylist(), rows.column("attrs").to_pylist(), strict=True):
            extra = json.loads(attrs_)
            table.append(json.loads(own_) | {k: json.loads(v) if coded and v is not None else v for k, v in extra.items()})
        shapes, places = shapes_of(kind, [[[(p["lat"], p["lon"]) for p in r] for r in rings] for rings in rings_])
        system, base = fs.FileSystem.from_uri(stem)
        system.create_dir(base.rpartition("/")[0], recursive=True)
        for end, data in ((".shp", shapes), (".shx", places), (".dbf", table_of(table))):
            with system.open_output_stream(f"{base}_{kind}{end}", compression=None) as to:
                to.write(data)
        return pa.table({"gtype": [kind], "records": [len(rings_)]})

    rows.groupBy("gtype").applyInArrow(run, "gtype string, records long").collect()


# --- GMT lines with attributes --------------------------------------------------------------------


def _cells(line: str) -> list[str]:
    """Fields between bars; quotes protect bars, a backslash protects a quote."""
    out, cell, quoted, escaped = [], "", False, False
    for c in line:
        if escaped:
            cell, escaped = cell + c, False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif c == "|" and not quoted:
            out.append(cell)
            cell = ""
        else:
            cell += c
    return [*out, cell]


def _typed(cell: str, kind: str):
    if cell == "":
        return None
    try:
        return int(cell) if kind == "integer" else float(cell) if kind == "double" else cell
    except ValueError:
        return cell


def parse_gmt(rows: list[tuple[int, str]]) -> Iterator[tuple[int, str, list, dict]]:
    """(number, kind, rings, attributes as JSON) of a GMT file with embedded attributes."""
    kind, names, types = "polyline", [], []
    feature: dict | None = None
    made: list[dict] = []
    hole = False
    for _, line in rows:
        s = line.strip()
        if s.startswith("#"):
            for word in s[1:].strip().split(" @") if "@" in s else []:
                word = word.lstrip("@")
                tag, rest = word[:1], word[1:]
                if tag == "G":
                    kind = {"POINT": "point", "MULTIPOINT": "multipoint", "LINESTRING": "polyline", "MULTILINESTRING": "polyline", "POLYGON": "polygon", "MULTIPOLYGON": "polygon"}.get(rest.strip().upper(), kind)
                elif tag == "N":
                    names = _cells(rest)
                elif tag == "T":
                    types = _cells(rest)
                elif tag == "D":
                    if kind == "point" or feature is None:
                        feature = {"kind": kind, "rings": [[]], "attrs": {}}
                        made.append(feature)
                    feature["attrs"] = {n: _typed(c, t) for n, c, t in zip(names, _cells(s[s.index("@D") + 2 :]), types or ["string"] * len(names), strict=False)}
                    break
                elif tag == "H":
                    hole = True
        elif s.startswith(">"):
            feature = {"kind": kind, "rings": [[]], "attrs": {}}
            made.append(feature)
            hole = False
        elif s:
            if feature is None:
                feature = {"kind": kind, "rings": [[]], "attrs": {}}
                made.append(feature)
            lon, lat = map(float, s.split()[:2])
            if hole:
                feature["hole"] = True
            feature["rings"][-1].append((lat, lon))
            if kind == "point":
                feature = None
    out: list[dict] = []
    for f in made:
        if not f["rings"][0]:
            continue
        if f["kind"] == "polygon":
            f["rings"] = [r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in f["rings"]]
        if f.get("hole") and out:
            out[-1]["rings"] += f["rings"]
        else:
            out.append(f)
    for n, f in enumerate(out, 1):
        yield n, f["kind"], _coordinates(f["rings"]), {k: json.dumps(v) for k, v in f["attrs"].items()}


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, gtype, rings, attributes) of GMT files, also those without attributes."""
    return _variants(text.per_file(text.file_lines(spark, path), parse_gmt, SCHEMA))


def gmt_lines(features: DataFrame, *attributes: str) -> DataFrame:
    """(line, value): features of one kind with attribute columns, by column expressions."""
    types = dict(features.dtypes)
    kind_of = lambda t: "integer" if t in ("bigint", "int") else "double" if t == "double" else "string"
    names = "|".join(attributes)
    cell = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) if kind_of(types[c]) == "string" else F.col(c).cast("string"), F.lit(""))
    data = F.concat(F.lit("# @D"), F.concat_ws("|", *(cell(c) for c in attributes))) if attributes else F.lit("#")
    pair = lambda p: F.format_string("%.10g %.10g", p["lon"], p["lat"])
    closed = lambda r: F.concat(r, F.slice(r, F.lit(1), F.lit(1)))
    polygon = F.col("gtype") == "polygon"
    shown = lambda r: F.when(polygon, F.transform(closed(r), pair)).otherwise(F.transform(r, pair))
    first = F.concat(F.array(F.lit(">"), data), F.when(polygon, F.array(F.lit("# @P"))).otherwise(F.slice(F.array(F.lit("")), F.lit(1), F.lit(0))), shown(F.element_at("rings", 1)))
    holes = F.transform(F.slice("rings", F.lit(2), F.greatest(F.size("rings") - 1, F.lit(0))), lambda r: F.concat(F.array(F.lit(">"), F.lit("# @H")), F.transform(closed(r), pair)))
    points = F.concat(F.array(data), F.transform(F.element_at("rings", 1), pair))
    body = F.when(F.col("gtype") == "point", points).otherwise(F.concat(first, F.flatten(holes)))
    rows = features.select((F.monotonically_increasing_id() + 1).alias("line"), F.array_join(body, "\n").alias("value"))
    name = {"point": "POINT", "multipoint": "MULTIPOINT", "polyline": "LINESTRING", "polygon": "POLYGON"}
    one = features.agg(F.min("gtype").alias("a"), F.max("gtype").alias("b"))
    kinds = F.create_map(*(F.lit(x) for kv in name.items() for x in kv))
    top = one.select(F.lit(0).cast("long").alias("line"), F.concat(F.lit("# @VGMT1.0 @G"), F.when(F.col("a") == F.col("b"), F.element_at(kinds, F.col("a"))).otherwise(F.raise_error(F.lit("a file holds one kind"))), F.lit(f"\n# @N{names}\n# @T{'|'.join(kind_of(types[c]) for c in attributes)}\n# FEATURE_DATA")).alias("value"))
    return top.unionByName(rows)


# --- grids, picks and other exports ----------------------------------------------------------------


def check_numeric(pixels: DataFrame, band: str, value: str = "value") -> DataFrame:
    """Pixels of a band, which must be of numbers: colours have no statistics."""
    kind = dict(pixels.dtypes)[value]
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kind.startswith("decimal"):
        raise ValueError(f"band {band!r} holds {kind}, not numbers")
    return pixels.where(F.col("band") == band)


def grid_lines(pixels: DataFrame) -> DataFrame:
    """(line, value): longitude, latitude and value; NaN where there is no coverage.  From
    north to south, west to east."""
    covered = (F.coalesce(F.col("coverage"), F.lit(1.0)) > 0) & F.col("value").isNotNull()
    shown = F.when(covered, F.col("value").cast("double").cast("string")).otherwise("NaN")
    return pixels.select(F.struct((-F.col("lat")).alias("a"), F.col("lon").alias("b")).alias("line"), F.concat_ws(" ", F.col("lon").cast("string"), F.col("lat").cast("string"), shown).alias("value"))


def write_grid(pixels: DataFrame, path: str, band: str) -> None:
    """A band as parts of a text grid, sorted across them: no task writes the whole raster."""
    grid_lines(check_numeric(pixels, band)).orderBy("line").select("value").write.mode("overwrite").text(path)


def pick_lines(picks: DataFrame) -> DataFrame:
    """(line, value): pole-fit picks as :func:`driftplane.sources.text.read_picks` reads them."""
    code = F.when(F.col("moving"), 2).otherwise(1) + F.when(F.coalesce("enabled", F.lit(True)), 0).otherwise(30)
    return picks.select("line", F.format_string("%d %d %.4f %.4f %.4f", code, "segment", "lat", "lon", "sigma").alias("value"))


def deformation_lines(points: DataFrame, *values: str, header: str = "") -> DataFrame:
    """(line, value): latitude, longitude and values (dilatation, strain, ...) a point, a ``>``
    header for each feature."""
    rows = points.select(F.struct("feature_id", F.lit(1).alias("k"), "point_idx").alias("line"), F.concat_ws(" ", F.format_string("%.6f", "lat"), F.format_string("%.6f", "lon"), *(F.format_string("%.8e", F.col(v).cast("double")) for v in values)).alias("value"))
    heads = points.select("feature_id").distinct().select(F.struct("feature_id", F.lit(0).alias("k"), F.lit(0).cast(dict(points.dtypes)["point_idx"]).alias("point_idx")).alias("line"), F.concat(F.lit(f"> {header}".rstrip() + " "), F.col("feature_id").cast("string")).alias("value"))
    return heads.unionByName(rows)


def topology_lines(rings: DataFrame) -> DataFrame:
    """(line, value) of resolved boundaries (topology_id, ring): GMT text, closed."""
    from ..functions import sphere as S

    closed = F.concat("ring", F.slice("ring", F.lit(1), F.lit(1)))
    points = F.transform(closed, lambda p: F.format_string("%.6f %.6f", S.lon(p), S.lat(p)))
    return rings.select(F.col("topology_id").alias("line"), F.array_join(F.concat(F.array(F.concat(F.lit("> "), F.col("topology_id").cast("string"))), points), "\n").alias("value"))
