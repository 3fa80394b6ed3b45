"""Line-based formats.  Files are read whole, one row a file, so that line order is kept
however Spark splits the work; each file of these formats is small by nature."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sphere as S
from ..operators import rotation_model as R


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value), lines numbered from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return rows.select("file", (F.col("line") + 1).alias("line"), "value")


def part_lines(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`file_lines`, for formats whose lines tell all by themselves: large files are
    read in parts, by many tasks, and no task holds a file."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"), "value")
    # a row a part: its first number, and how many lines its file has before it
    parts = rows.groupBy("file", "_block").agg(F.min("_n").alias("_first"), F.count("*").alias("_lines"))
    before = F.sum("_lines").over(Window.partitionBy("file").orderBy("_block")) - F.col("_lines")
    parts = parts.select("file", "_block", (before - F.col("_first") + 1).alias("_from"))
    return rows.join(F.broadcast(parts), ["file", "_block"]).select("file", (F.col("_n") + F.col("_from")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def per_file(lines: DataFrame, parse: Callable[[list[tuple[int, str]]], Iterable[tuple]], schema: str) -> DataFrame:
    """Applies a parser of (line, value) pairs to each file."""
    names = [c.split(":")[0].strip().split()[0] for c in _fields(schema)]

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("line")
        rows = [(key[0], *r) for r in parse(list(zip(frame["line"].tolist(), frame["value"].tolist(), strict=True)))]
        return pd.DataFrame(rows, columns=["file", *names]).astype(object)

    return lines.groupBy("file").applyInPandas(run, f"file string, {schema}")


def _fields(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


POLE = r"^\s*(\d+)\s+([-+0-9.eE]+)\s+([-+0-9.eE]+)\s+([-+0-9.eE]+)\s+([-+0-9.eE]+)\s+(\d+)\s*(?:!(.*))?$"
ROTATION_SCHEMA = "line long, seq long, moving long, fixed long, time double, lat double, lon double, angle double, disabled boolean, comment string"


def poles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) lines of rotation files.  Good: file, line, moving, time, lat, lon, angle,
    fixed, comment.  A line is bad if it is no pole, has impossible coordinates, or turns a
    plate about itself; blank lines and metadata lines are neither."""
    lines = file_lines(spark, path).where((F.trim("value") != "") & ~F.col("value").rlike(r"^\s*[@#>]"))
    part = lambda i: F.regexp_extract("value", POLE, i)
    parsed = lines.withColumn("ok", F.col("value").rlike(POLE)).select(
        "file", "line", "value", "ok", part(1).try_cast("long").alias("moving"), part(2).try_cast("double").alias("time"), part(3).try_cast("double").alias("lat"), part(4).try_cast("double").alias("lon"), part(5).try_cast("double").alias("angle"), part(6).try_cast("long").alias("fixed"), F.trim(part(7)).alias("comment")
    )
    good = F.col("ok") & F.col("time").isNotNull() & F.col("angle").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-360, 360) & ((F.col("moving") != F.col("fixed")) | (F.col("moving") == R.DISABLED_PLATE))
    good = F.coalesce(good, F.lit(False))
    return parsed.where(good).drop("ok", "value"), parsed.where(~good).select("file", "line", "value")


def read_rotations(spark: SparkSession, path: str) -> DataFrame:
    """Samples of rotation files, grouped in sequences: what the rotation model takes."""
    good, _ = poles(spark, path)

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("line").reset_index(drop=True)
        found = R.group_sequences(zip(frame["moving"].tolist(), frame["time"].tolist(), frame["fixed"].tolist(), strict=True))
        made = pd.DataFrame(found, columns=["seq", "moving", "fixed", "disabled"])
        return pd.concat([frame[["file", "line"]], made, frame[["time", "lat", "lon", "angle", "comment"]]], axis=1)[["file", "line", "seq", "moving", "fixed", "time", "lat", "lon", "angle", "disabled", "comment"]]

    rows = good.groupBy("file").applyInPandas(run, f"file string, {ROTATION_SCHEMA}")
    # sequences of later files come after those of earlier ones
    nth = good.select("file").distinct().withColumn("_n", F.row_number().over(Window.orderBy("file")) - 1)
    return rows.join(nth, "file").withColumn("seq", F.col("seq") + F.col("_n") * F.lit(1 << 32)).drop("_n")


def rotation_lines(samples: DataFrame) -> DataFrame:
    """(line, value): samples as rotation-file text; disabled ones as plate 999."""
    value = F.format_string("%03d %8.4f %9.4f %9.4f %9.4f  %03d !%s", F.when(F.col("disabled"), R.DISABLED_PLATE).otherwise(F.col("moving")), "time", "lat", "lon", "angle", "fixed", F.coalesce("comment", F.lit("")))
    return samples.select("line", value.alias("value"))


def write_lines(lines: DataFrame, path: str, order: str = "line", parts: bool = False) -> None:
    """Lines in one text file (these formats are ordered); for files of bounded size.
    ``parts``: in as many files as there are tasks, each with the lines that follow those of
    the one before, for formats whose lines tell all by themselves."""
    rows = lines.orderBy(order).select("value")
    (rows if parts else rows.coalesce(1)).write.mode("overwrite").text(path)


def read_metadata_rotations(spark: SparkSession, path: str) -> DataFrame:
    """Metadata rotation files: samples with ``attributes`` of the file, of their sequence
    (``> @MPRS`` and following header lines) and of their own line (``@name"value"``)."""
    lines = file_lines(spark, path)

    def parse(rows):
        import re

        of_file: dict[str, str] = {}
        of_seq: dict[str, str] = {}
        poles_, kept = [], []
        for n, value in rows:
            body, _, tail = value.partition("@") if not value.lstrip().startswith((">", "@")) else ("", "", "")
            if value.lstrip().startswith(">"):
                of_seq = {} if "MPRS" in value else of_seq
                of_seq |= {k: v.strip('" ') for k, v in re.findall(r'@([A-Za-z:_0-9]+)\s*("[^"]*"|[^@]*)', value)}
            elif value.lstrip().startswith("@"):
                of_file |= {k: v.strip('" ') for k, v in re.findall(r'@([A-Za-z:_0-9]+)\s*("[^"]*"|[^@]*)', value)}
            elif m := re.match(POLE, body.split("!")[0].rstrip().lstrip("#") + " "):
                off = body.lstrip().startswith("#")
                own = {k: v.strip('" ') for k, v in re.findall(r'([A-Za-z:_0-9]+)\s*("[^"]*"|[^@]*)', tail)} if tail else {}
                moving, time, lat, lon, angle, fixed = int(m[1]), *map(float, m.groups()[1:5]), int(m[6])
                poles_.append((R.DISABLED_PLATE if off else moving, time, fixed))
                kept.append((n, lat, lon, angle, time, {**of_file, **of_seq, **own}))
        for (seq, moving, fixed, off), (n, lat, lon, angle, time, attributes) in zip(R.group_sequences(poles_), kept, strict=True):
            yield n, seq, moving, fixed, time, lat, lon, angle, off, attributes

    return per_file(lines, parse, "line long, seq long, moving long, fixed long, time double, lat double, lon double, angle double, disabled boolean, attributes map<string, string>")


FEATURE_SCHEMA = "line long, feature_type string, name string, plate_id long, conjugate long, begin double, end double, gtype string, coordinates array<struct<lat: double, lon: double>>"


def read_plates_lines(spark: SparkSession, path: str) -> DataFrame:
    """PLATES4 line files: two header lines, then (latitude, longitude, pen) points; pen 3
    lifts, 2 draws, and 99.0 99.0 ends a feature."""
    lines = file_lines(spark, path)

    def parse(rows):
        i = 0
        while i + 1 < len(rows):
            n, first = rows[i]
            if not first.strip():
                i += 1
                continue
            head = rows[i + 1][1].split()
            if len(head) < 3:
                i += 1
                continue
            i += 2
            runs: list[list[tuple[float, float]]] = []
            while i < len(rows):
                p = rows[i][1].split()
                i += 1
                if len(p) < 3:
                    continue
                la, lo, pen = float(p[0]), float(p[1]), int(float(p[2]))
                if abs(la) > 90:
                    break
                if pen == 3 or not runs:
                    runs.append([])
                runs[-1].append((la, lo))
            number = lambda k: int(head[k]) if len(head) > k and head[k].lstrip("-").isdigit() else None  # noqa: B023, E731
            time = lambda k: float("inf") if float(head[k]) >= 999 else float("-inf") if float(head[k]) <= -999 else float(head[k])  # noqa: B023, E731
            for run in runs:
                kind = "point" if len(run) == 1 else "polyline"
                yield n, head[3] if len(head) > 3 else "", first[first.find(" ") + 1 :].strip(), number(0), number(5), time(1), time(2), kind, [{"lat": a, "lon": b} for a, b in run]

    return per_file(lines, parse, FEATURE_SCHEMA)


def plates_lines(features: DataFrame) -> DataFrame:
    """(line, value): features (plate_id, name, begin, end, coordinates) as PLATES4 text."""
    t = lambda c, far: F.when(F.abs(F.col(c)) == float("inf"), F.lit(far)).otherwise(F.col(c))
    conjugate = F.coalesce("conjugate", F.lit(0)).cast("long") if "conjugate" in features.columns else F.lit(0)
    head = F.array(F.concat(F.lit("0000 "), F.coalesce("name", F.lit(""))), F.format_string(" %4d %6.1f %6.1f %s %04d %d %d %d", "plate_id", t("begin", 999.0), t("end", -999.0), F.coalesce("feature_type", F.lit("UN")), F.lit(1), conjugate, F.lit(1), F.size("coordinates")))
    points = F.transform("coordinates", lambda p, i: F.format_string("%9.4f %9.4f %d", p["lat"], p["lon"], F.when(i == 0, 3).otherwise(2)))
    value = F.concat(head, points, F.array(F.lit("  99.0000   99.0000 3")))
    return features.select("line", F.array_join(value, "\n").alias("value"))


def xy_lines(features: DataFrame) -> DataFrame:
    """(line, value): GMT text, a ``>`` header and longitude-latitude rows."""
    points = F.transform("coordinates", lambda p: F.format_string("%.6f %.6f", p["lon"], p["lat"]))
    head = F.format_string("> %s %s", F.coalesce(F.col("plate_id").cast("string"), F.lit("")), F.coalesce("name", F.lit("")))
    return features.select("line", F.array_join(F.concat(F.array(head), points), "\n").alias("value"))


def read_poles_file(spark: SparkSession, path: str) -> DataFrame:
    """Virtual geomagnetic poles: a title line, then one line of numbers a pole:
    N, k, a95, age, site latitude and longitude, declination, inclination, dm, dp, pole
    latitude and longitude.  Lines of fewer numbers are skipped."""
    lines = file_lines(spark, path)
    names = ("n", "k", "a95", "age", "site_lat", "site_lon", "dec", "inc", "dm", "dp", "lat", "lon")
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x.rlike(r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$"))
    rows = lines.withColumn("_p", parts).where((F.size("_p") >= len(names)) & (F.size("_p") == F.size(F.split(F.trim("value"), r"\s+"))))
    return rows.select("file", "line", *(F.element_at("_p", i + 1).try_cast("double").alias(c) for i, c in enumerate(names)))


def read_palette(spark: SparkSession, path: str, max_lines: int = 100_000):
    """A colour-table file as a :class:`driftplane.functions.palettes.Palette`; a file of more
    than ``max_lines`` lines is an error."""
    from ..functions.palettes import Palette, Slice

    slices, categories, special = [], [], {}
    rows = file_lines(spark, path).orderBy("line").limit(max_lines + 1).collect()
    if len(rows) > max_lines:
        raise ValueError(f"more than {max_lines} lines in {path}; raise max_lines")
    for row in rows:
        t = row["value"].split("#")[0].replace("/", " ").split()
        if not t:
            continue
        if t[0] in ("B", "F", "N"):
            special[t[0]] = tuple(map(float, t[1:4])) if len(t) >= 4 else (float(t[1]),) * 3
        elif len(t) >= 8:
            v = list(map(float, t[:8]))
            slices.append(Slice(v[0], tuple(v[1:4]), v[4], tuple(v[5:8])))
        elif len(t) >= 4:
            categories.append((t[0], tuple(map(float, t[1:4]))))
    return Palette(tuple(slices), tuple(categories), special.get("B"), special.get("F"), special.get("N"))


def read_age_model(spark: SparkSession, path: str) -> DataFrame:
    """(model, chron, age): a header line of ``#`` names the models, rows are a chron and an
    age for each (missing ones are ``-`` or blank)."""
    lines = file_lines(spark, path)

    def parse(rows):
        models: list[str] = []
        for _, value in rows:
            t = value.split()
            if not t:
                continue
            if value.startswith("#"):
                models = [m for m in value.lstrip("# ").split() if m.lower() != "chron"] or models
                continue
            for m, a in zip(models or ["model"], t[1:], strict=False):
                if a != "-":
                    yield m, t[0], float(a)

    return per_file(lines, parse, "model string, chron string, age double")


def read_picks(spark: SparkSession, path: str) -> DataFrame:
    """Pole-fit picks: ``plate segment latitude longitude sigma`` a line, plate 1 or 2 (31 and
    32 are picks switched off); the second plate moves."""
    lines = part_lines(spark, path)
    p = F.split(F.trim("value"), r"[\s,]+")
    rows = lines.where(F.size(p) >= 5).select("file", "line", F.get(p, 0).try_cast("int").alias("_c"), F.get(p, 1).try_cast("int").alias("segment"), *(F.get(p, i).try_cast("double").alias(n) for i, n in ((2, "lat"), (3, "lon"), (4, "sigma"))))
    return rows.where("_c in (1, 2, 31, 32)").select("file", "line", ((F.col("_c") % 10) == 2).alias("moving"), "segment", "lat", "lon", "sigma", (F.col("_c") < 10).alias("enabled"))


def config_section(lines: list[str], name: str) -> list[str]:
    """Lines of the section ``[name]`` or ``name``: comments dropped, ends at a blank line."""
    out, on = [], False
    for line in lines:
        s = line.strip()
        if on and not s:
            break
        if on and not s.startswith("#"):
            out.append(s)
        if s.strip("[]:").lower() == name.lower():
            on = True
    return out


def points_of(features: DataFrame) -> DataFrame:
    """Adds ``line``'s unit vectors as ``points`` from ``coordinates``."""
    return features.withColumn("points", F.transform("coordinates", lambda p: S.from_lat_lon(p["lat"], p["lon"])))
