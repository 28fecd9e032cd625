"""Classifier evaluation, threshold sweeps and set metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    one = F.lit(1)
    p, r = tp / F.greatest(tp + fp, one), tp / F.greatest(tp + fn, one)
    return {
        "precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)),
        "accuracy": (tp + tn) / F.greatest(tp + fp + fn + tn, one), "iou": tp / F.greatest(tp + fp + fn, one),
    }


def confusion(df: DataFrame, predicted: Column, truth: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, F1, accuracy and IoU over all rows of a group (micro); empty denominators count as 1."""
    counts = df.groupBy(*by).agg(
        F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"), F.count_if(~predicted & ~truth).alias("tn"))
    return counts.withColumns(_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def threshold_sweep(df: DataFrame, score: str, truth: Column, thresholds: list[float], *by: str) -> DataFrame:
    """confusion() at each threshold (score >= threshold)."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    return confusion(df.select("*", t), F.col(score) >= F.col("threshold"), truth, *by, "threshold")


def best_threshold(sweep: DataFrame, *by: str) -> DataFrame:
    """The threshold of the best F1; the first wins ties."""
    return sweep.groupBy(*by).agg(F.max(F.struct("f1", -F.col("threshold"))).alias("b")).select(*by, (-F.col("b.col2")).alias("threshold"), F.col("b.f1").alias("f1"))


def macro(tiles: DataFrame, filled: Column, *measures: str) -> DataFrame:
    """Means of per-tile measures over all tiles, and over those where filled holds (<name>_filled)."""
    return tiles.agg(*[F.avg(m).alias(m) for m in measures], *[F.avg(F.when(filled, F.col(m))).alias(f"{m}_filled") for m in measures])


def tile_overlap(df: DataFrame, predicted: Column, truth: Column, tile: str) -> DataFrame:
    """Dice and IoU of each tile; a tile without either counts as 1."""
    both, p, t = F.count_if(predicted & truth), F.count_if(predicted), F.count_if(truth)
    return df.groupBy(tile).agg(F.coalesce(F.try_divide(2 * both, p + t), F.lit(1.0)).alias("dice"), F.coalesce(F.try_divide(both, p + t - both), F.lit(1.0)).alias("iou"), t.alias("n_truth"))


def any_over(df: DataFrame, group: str, score: str, threshold: Column) -> DataFrame:
    """df with candidate: whether any row of the group reaches its threshold."""
    return df.withColumn("candidate", F.bool_or(F.col(score) >= threshold).over(Window.partitionBy(group)))


def set_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of both, only a, only b, and the Jaccard index, of two sets of rows with the same columns; 1 if both are empty."""
    keys = a.columns
    joined = a.distinct().withColumn("__a", F.lit(1)).join(b.distinct().withColumn("__b", F.lit(1)), keys, "full_outer")
    both, all_ = F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()), F.count("*")
    return joined.agg(both.alias("both"), F.count_if(F.col("__b").isNull()).alias("only_a"), F.count_if(F.col("__a").isNull()).alias("only_b"), F.coalesce(F.try_divide(both, all_), F.lit(1.0)).alias("jaccard"))


def array_jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts in fixed bins, the last closed on the right, and the cumulative per cent; values outside count nowhere. Empty bins are 0."""
    last = len(edges) - 2
    v = F.col(value)
    b = F.when((v < edges[0]) | (v > edges[-1]) | v.isNull(), None)
    for k in range(last + 1):
        b = b.when(v < edges[k + 1] if k < last else v <= edges[k + 1], k)
    counts = df.select(b.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    full = bins.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row for each bin
    return full.withColumn("cum_pct", 100 * F.try_divide(F.sum("n").over(upto), F.sum("n").over(Window.partitionBy())))


def percentiles(df: DataFrame, value: str, shares: list[float], *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(f"p{round(100 * p):02d}") for p in shares])


def tier_thresholds(base: Column, step: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), base + step))


def top_ranked(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in that order, with rank; a TakeOrdered plan, ranked among n rows only."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def first_per_cell(df: DataFrame, cell: float, n_cells: int, *order: Column | str) -> DataFrame:
    """The first row of each grid cell (x, y), and of those the first n_cells."""
    w = Window.partitionBy(F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)).orderBy(*order)
    return top_ranked(df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n"), n_cells, *order)


def hashed_sample(df: DataFrame, n: int, key: str, seed: int = 0, *by: str) -> DataFrame:
    """n rows (of each group) by the hash of their key: the same rows in any order and on any cluster."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    if not by:
        return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(h, key))).filter(F.col("__n") <= n).drop("__n")


def logistic_fit(df: DataFrame, features: str, label: str, rounds: int = 50):
    """Balanced logistic regression on array features; the weights of a class are inverse to its share."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row for each class
    total, kinds = sum(n.values()), len(n)
    weight = F.lit(1.0)
    for k, c in n.items():
        weight = F.when(F.col(label) == k, total / (kinds * c)).otherwise(weight)
    data = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), weight.alias("weight"))
    return LogisticRegression(weightCol="weight", maxIter=rounds).fit(data)


def cross_validated(df: DataFrame, features: str, label: str, group: str, folds: int = 5) -> DataFrame:
    """(row columns, fold, prob): each row's probability from the model fitted without its fold; rows of a group share one."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    folded = df.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int"))
    out = None
    for k in range(folds):
        model = logistic_fit(folded.filter(F.col("fold") != k), features, label)
        held = folded.filter(F.col("fold") == k).withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
        part = model.transform(held).select(*folded.columns, vector_to_array("probability")[1].alias("prob"))
        out = part if out is None else out.unionByName(part)
    return out


def distance_band(d: Column, facing: Column, near: float = 12, far: float = 80, front: float = 50) -> Column:
    """1 near and facing, 0 far off, null between."""
    return F.when((d <= near) & (facing < front), 1).when(d >= far, 0)
