"""Gaps and islands: runs, intervals and step functions over ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def number_islands(df: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """df and `island`: a running count of the rows where starts holds (null counts as true)."""
    w = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("island", F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(w))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values: keys, island, the value, n and the place of the first and last row (from 0)."""
    w = _ordered(keys, order)
    changed = ~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)
    placed = df.withColumn("__at", F.row_number().over(w) - 1).withColumn("__new", changed)
    return number_islands(placed, keys, order, F.col("__new")).groupBy(*keys, "island").agg(
        F.first(value).alias(value), F.count("*").alias("n"), F.min("__at").alias("first_at"), F.max("__at").alias("last_at"))


def true_runs(df: DataFrame, keys: list[str], order: list[str], flag: str, least: int = 1) -> DataFrame:
    """Runs of rows where flag is true, of at least so many rows."""
    return run_lengths(df.withColumn(flag, F.coalesce(F.col(flag), F.lit(False))), keys, order, flag).filter(F.col(flag) & (F.col("n") >= least))


def run_round(df: DataFrame, keys: list[str], order: list[str], flag: str, target: str) -> DataFrame:
    """The true run that holds the row number `target` (a column of df, the same in all rows of a key; from 0)."""
    at = df.groupBy(*keys).agg(F.max(target).alias("__target"))
    return true_runs(df, keys, order, flag).join(at, keys).filter(F.col("__target").between(F.col("first_at"), F.col("last_at"))).drop("__target")


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching intervals: keys, island, start, end."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    opened = df.withColumn("__new", F.col(start) > F.max(end).over(before))
    return number_islands(opened, keys, [start, end], F.col("__new")).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end))


def covered_length(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    return merged_intervals(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Room between consecutive intervals in order of start; negative where they overlap, null after the last."""
    return df.withColumn("gap", F.lead(start).over(_ordered(keys, [start, end])) - F.col(end))


def cumulative(df: DataFrame, keys: list[str], order: list[str], length: str) -> DataFrame:
    """df with from_at and to_at: the running sum before and after each row."""
    w = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("to_at", F.sum(length).over(w)).withColumn("from_at", F.col("to_at") - F.col(length))


def locate(df: DataFrame, keys: list[str], order: list[str], length: str, at: Column) -> DataFrame:
    """The row of each key in which the running length passes `at`."""
    return cumulative(df, keys, order, length).filter((F.col("from_at") <= at) & (at < F.col("to_at")))


def longest_run(df: DataFrame, keys: list[str], order: list[str], flag: str, length: str) -> DataFrame:
    """The greatest total length of consecutive rows where flag holds; 0 if none."""
    w = _ordered(keys, order)
    f = F.coalesce(F.col(flag), F.lit(False))
    marked = df.withColumn("__f", f).withColumn("__new", ~F.lag(f).over(w).eqNullSafe(f))
    runs = number_islands(marked, keys, order, F.col("__new")).groupBy(*keys, "island").agg(F.sum(F.when(F.col("__f"), F.col(length)).otherwise(0)).alias("run"))
    return runs.groupBy(*keys).agg(F.max("run").alias("longest"))


def over_threshold(df: DataFrame, keys: list[str], order: list[str], seconds: str, value: str, threshold: float) -> DataFrame:
    """df with held: seconds since the value went over the threshold without a drop since, 0 at or below it."""
    w = _ordered(keys, order)
    hot = F.coalesce(F.col(value) > threshold, F.lit(False))
    marked = df.withColumn("__hot", hot).withColumn("__new", ~F.lag(hot).over(w).eqNullSafe(hot))
    numbered = number_islands(marked, keys, order, F.col("__new"))
    first = Window.partitionBy(*keys, "island").orderBy(*order)
    return numbered.withColumn("held", F.when(F.col("__hot"), F.col(seconds) - F.first(seconds).over(first)).otherwise(0)).drop("__hot", "__new", "island")


def step_hours(df: DataFrame, keys: list[str], until_minutes: str, value: str) -> DataFrame:
    """Expands `until` steps (minutes of the day, exclusive) to hours 0..23; a step that ends within an hour takes the whole hour."""
    end = F.least(F.lit(24), F.ceil(F.col(until_minutes) / 60)).cast("int")
    w = Window.partitionBy(*keys).orderBy(until_minutes)
    spans = df.withColumn("__to", end).withColumn("__from", F.coalesce(F.lag(end).over(w), F.lit(0)))
    return spans.filter("__to > __from").withColumn("hour", F.explode(F.sequence(F.col("__from"), F.col("__to") - 1))).select(*keys, "hour", value)


def rolling_max(df: DataFrame, keys: list[str], order: str, value: str, reach: int = 1) -> Column:
    """Centred rolling maximum, clamped at the ends of the key's rows."""
    return F.max(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach))


def keep_one(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in that order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def turns(df: DataFrame, keys: list[str], order: str, ring: bool = False) -> DataFrame:
    """df (x, y) with turn: degrees between the steps into and out of each vertex; null at the ends of an open line. A ring wraps."""
    from penumbra.functions.geometry import angle

    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = lambda c, f, g: F.coalesce(f(c).over(w), g(c).over(whole)) if ring else f(c).over(w)
    px, py, nx, ny = (step(c, f, g) for f, g in ((F.lag, F.last), (F.lead, F.first)) for c in ("x", "y"))
    return df.withColumn("turn", angle(F.col("x") - px, F.col("y") - py, nx - F.col("x"), ny - F.col("y")))
