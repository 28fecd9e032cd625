"""Scans of the formats that the analytics take in. Schemas are declared; codes stay text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A fixed format: pid_lon_lat_yyyymm_baseheadingX_viewheadingY_view.jpg
VIEW_NAME = r"^(\d+)_(-?\d+\.\d+)_(-?\d+\.\d+)_(\d{6})_baseheading(-?\d+\.\d+)_viewheading(-?\d+\.\d+)_(\d)\.jpg$"


def csv_union(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """CSV files with a header under one declared schema."""
    return spark.read.schema(schema).option("header", True).csv(paths)


def csv_text(spark: SparkSession, path: str, codes: list[str], numbers: list[str]) -> DataFrame:
    """All columns read as text; headers in any case; codes trimmed, numbers null -> 0."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    at = {c.strip().lower(): c for c in raw.columns}
    return raw.select(*[F.trim(F.col(f"`{at[c.lower()]}`")).alias(c) for c in codes], *[F.coalesce(F.trim(F.col(f"`{at[c.lower()]}`")), F.lit("0")).cast("double").alias(c) for c in numbers])


def points_in_box(spark: SparkSession, path: str, columns: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    """A projected scan with the box pushed down to the Parquet footer statistics of x and y."""
    x0, y0, x1, y1 = box
    return spark.read.parquet(path).select(*columns, "x", "y").filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def view_names(files: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Parsed image names (pid, lon, lat, date, baseheading, viewheading, view_idx), and the number of those that do not match; files of other kinds are neither."""
    images = files.filter(F.lower(name).endswith(".jpg"))
    kinds = {"pid": "long", "lon": "double", "lat": "double", "date": "string", "baseheading": "double", "viewheading": "double", "view_idx": "int"}
    good = F.col(name).rlike(VIEW_NAME)
    parsed = images.filter(good).select(name, *[F.regexp_extract(name, VIEW_NAME, i).cast(t).alias(k) for i, (k, t) in enumerate(kinds.items(), 1)])
    return parsed, images.agg(F.count_if(~good).alias("skipped"))


def label_polygons(lines: DataFrame, column: str = "value") -> DataFrame:
    """Polygons of at least three points in annotation JSON: (doc, shape, label, points)."""
    schema = "shapes array<struct<label:string,points:array<array<double>>,shape_type:string>>"
    parsed = lines.withColumn("__j", F.from_json(column, schema))
    return parsed.select("doc", F.posexplode("__j.shapes").alias("shape", "s")).filter((F.col("s.shape_type") == "polygon") & (F.size("s.points") >= 3)).select("doc", "shape", "s.label", "s.points")


def objects_of(text: Column) -> Column:
    """Objects `type, field, ...;` of a hierarchical text: comments stripped, fields trimmed, empty ones inside kept."""
    bare = F.regexp_replace(text, r"![^\n]*", "")
    return F.filter(F.transform(F.split(bare, ";"), lambda o: F.transform(F.split(o, ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))), lambda o: (F.size(o) > 1) | (F.get(o, F.lit(0)) != ""))


def met_rows(lines: DataFrame, column: str = "value", least: int = 4) -> DataFrame:
    """White-space separated forcing rows as arrays of doubles; the header goes, a row of fewer columns is an error."""
    parts = F.split(F.trim(column), r"\s+")
    rows = lines.filter(~F.col(column).rlike("[A-Za-z%]") & (F.trim(column) != "")).withColumn("__p", parts)
    checked = F.when(F.size("__p") < least, F.raise_error(F.lit("too few columns")).cast("array<string>")).otherwise(F.col("__p"))
    return rows.select(F.transform(checked, lambda x: x.cast("double")).alias("fields"))


def common_times(instant: DataFrame, accumulated: DataFrame, start: Column, end: Column) -> DataFrame:
    """Both streams at the times that they share within the window."""
    return instant.filter(F.col("time").between(start, end)).join(accumulated, "time")


def valid_time(df: DataFrame) -> Column:
    """valid_time, else time plus step hours, else time; without any of them an error."""
    has = set(df.columns)
    options = [F.col("valid_time")] if "valid_time" in has else []
    if {"time", "step"} <= has:
        options.append(F.col("time") + F.make_dt_interval(hours=F.col("step").cast("int")))
    if "time" in has:
        options.append(F.col("time"))
    if not options:
        raise ValueError("no time coordinate")
    return F.coalesce(*options)


def model_time(name: Column) -> tuple[Column, Column]:
    """Time and domain of a forecast file name; three forms of the time of day, anything else is null."""
    m = lambda p, i: F.nullif(F.regexp_extract(name, p, i), F.lit(""))
    head = r"wrfout_d(\d{2})_(\d{4}-\d{2}-\d{2})_"
    forms = [(head + r"(\d{2}_\d{2}_\d{2})$", "yyyy-MM-dd HH_mm_ss"), (head + r"(\d{2}:\d{2}:\d{2})$", "yyyy-MM-dd HH:mm:ss"), (head + r"(\d{2})$", "yyyy-MM-dd HH")]
    times = [F.try_to_timestamp(F.concat_ws(" ", m(p, 2), m(p, 3)), F.lit(f)) for p, f in forms]
    valid = [F.when(m(p, 3).isNotNull(), t) for (p, _), t in zip(forms, times, strict=True)]
    return F.coalesce(*valid), F.coalesce(*[m(p, 1) for p, _ in forms]).cast("int")


def tile_maps(layers: dict[str, DataFrame]) -> DataFrame:
    """(key, x, y, one path column per layer) for the keys that all layers have, in numeric order."""
    from penumbra.functions.scalars import tile_key

    out = None
    for name, df in layers.items():
        part = df.select("key", F.col("path").alias(name))
        out = part if out is None else out.join(part, "key")
    x, y = tile_key(F.col("key"))
    return out.withColumn("x", x).withColumn("y", y).orderBy("x", "y", "key")


def open_source(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """A forcing source by kind (own, reanalysis, forecast); a parameter that is missing is an error."""
    need = {"own": ("path",), "reanalysis": ("instant", "accumulated"), "forecast": ("path", "start", "end")}
    if kind not in need:
        raise ValueError(f"unknown source {kind!r}")
    if missing := [k for k in need[kind] if not options.get(k)]:
        raise ValueError(f"{kind} needs {', '.join(missing)}")
    if kind == "own":
        return met_rows(spark.read.text(options["path"]))
    if kind == "reanalysis":
        a, b = spark.read.parquet(options["instant"]), spark.read.parquet(options["accumulated"])
        return a.join(b, "time")
    return spark.read.parquet(options["path"]).filter(F.col("time").between(F.to_timestamp(F.lit(options["start"])), F.to_timestamp(F.lit(options["end"]))))
