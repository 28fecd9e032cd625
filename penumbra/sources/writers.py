"""Sinks: Parquet, CSV and JSON, incremental appends, and resuming what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, replace: bool = False) -> None:
    """Refuses to overwrite unless told to."""
    w = df.write.mode("overwrite" if replace else "errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """CSV with a header; floating columns with fixed digits."""
    out = [F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*out).write.mode("errorifexists").option("header", True).csv(path)


def summary_json(df: DataFrame) -> DataFrame:
    """One JSON object for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def missing(todo: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows of todo whose keys the sink does not have."""
    spark = todo.sparkSession
    return todo if not _exists(spark, path) else todo.join(spark.read.parquet(path).select(*keys), keys, "left_anti")


def resume(todo: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> None:
    append(work(missing(todo, path, keys)), path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces old by key."""
    return old.join(new, keys, "left_anti").unionByName(new)


def merge_partials(parts: list[DataFrame], keys: list[str], *measures: str) -> DataFrame:
    """Partial sums of several workers added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
