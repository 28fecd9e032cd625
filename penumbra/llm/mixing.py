"""Mixing sources to target weights (operator 9), in DataFrame functions only.

Every document gets a hash-random key. Keys are cut into equal ranges, many for each source, so that a source of any
share of the rows is sorted and summed over many tasks; the sums of the ranges before a range, plus the running sum within
it, give each document's place in its source. The source's budget is then cut at an exact word: whole epochs for all,
one more time round for the documents before the cut, and a part of the one that the cut falls in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, table

#: Least number of key ranges of a source, and rows that one range of an evenly filled table holds at most.
LEAST_RANGES, RANGE_ROWS = 1024, 50_000


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) -> and target: shares of the total by weight, capped at most times the size, the excess reshared.

    Sources by code point, null last, take the weights in turn. Sources in order of cap per weight: while one's cap is below
    the level that those not yet capped would get, it is capped; the level after the last capped one holds for the rest.
    The table has a row for each source, so its windows are small.
    """
    by_name, cap = Window.orderBy(F.col("source").asc_nulls_last()), most * F.col("source_size")
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (1 + (F.row_number().over(by_name) - 1) % len(weights)).cast("int")).cast("long")
    level = (F.sum("source_size").over(total) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return (
        sizes.withColumn("weight", weight).withColumn("ratio", cap / F.col("weight"))
        .withColumn("level", level)
        .withColumn("water", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(total)["level"])
        .select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.coalesce("water", F.lit(0.0))).alias("target"))
    )


def mix(docs: DataFrame, seed: int = 9, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), epochs (whole copies), rest (words of one more), and carry.

    docs: doc_id, text, source. A null or wordless text has size 0 and nothing is taken of it; null is a source of its own,
    last in order. Ties of the key (repeated ids) are ordered by size, and rows equal in both share their places in any order.
    A null doc_id has a key of its own. Other columns are ignored; an empty table gives no rows. The key depends on
    seed and doc_id alone, so reruns agree.
    """
    spark = docs.sparkSession
    rows = docs.count()
    ranges = LEAST_RANGES
    while ranges * RANGE_ROWS < rows:
        ranges *= 2
    digits = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    sized = (
        docs.select("doc_id", "source", *carry, F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), digits.alias("key"))
        .withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges, 32))
        .repartition(parts(spark), "source", "range")
    )
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("ahead", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    goal = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), most, weights).withColumnRenamed("source", "goal_of")
    offsets = offsets.join(goal, F.col("source").eqNullSafe(F.col("goal_of"))).select(F.col("source").alias("in_source"), F.col("range").alias("in_range"), "ahead", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("near", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("range") == F.col("in_range")))
    return (
        placed.withColumn("budget", F.floor("target").cast("long"))
        .withColumn("epochs", F.coalesce(F.expr("try_divide(budget - budget % greatest(source_size, 1), source_size)").cast("long"), F.lit(0)))
        .withColumn("rest", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("ahead") - F.col("near"))).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"), "epochs", "rest", *carry)
    )


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with s as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size, md5(coalesce(cast(doc_id as varchar), 'null') || ':9') as key
  from documents
), t as (
  select source, cast(sum(size) as bigint) as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from s group by source
), l as (
  select *, 3 * source_size / weight as ratio, sum(source_size) over () as total, sum(weight) over () as weights,
    coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
    coalesce(sum(weight) over (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as gone
  from t
), v as (select *, cast(total - capped as double) / cast(weights - gone as double) as level from l),
w as (select min(level) as water from (select level from v where ratio >= level order by ratio limit 1)),
g as (select source, source_size, least(cast(3 * source_size as double), weight * coalesce(water, 0)) as target from v cross join w),
p as (
  select s.*, source_size, target, cast(floor(target) as bigint) as budget,
    coalesce(sum(size) over (partition by s.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead
  from s join g on s.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  cast(case when source_size = 0 then 0 else (budget // source_size) * size + greatest(0, least(size, budget % source_size - ahead)) end as bigint) as taken
from p
"""
