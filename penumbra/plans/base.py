"""Registration of queries, the driver's tables, and the bindings that stand in for the analytics' own inputs.

Each binding exists twice, as a DataFrame and as SQL text for the check, over the same integer expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, schema: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)

    # bindings

    def buildings(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.customer.select(k.alias("id"), (k * 7919 % 4000).alias("x"), (k * 10427 % 3000).alias("y"), F.col("c_mktsegment").alias("archetype"), (100 + k * 37 % 900).alias("gfa"))

    def stations(self) -> DataFrame:
        k = F.col("s_suppkey")
        mrt = k % 10 == 0
        return self.supplier.select(k.alias("id"), (k * 6151 % 4000).alias("x"), (k * 3571 % 3000).alias("y"), F.when(mrt, "MRT").otherwise("BUS").alias("source"), F.when(mrt, 800).otherwise(400).cast("long").alias("cutoff"))

    def rides(self) -> DataFrame:
        day = F.when(F.weekday("l_shipdate") >= 5, "WEEKENDS/HOLIDAY").otherwise("WEEKDAY")
        return self.lineitem.select(F.col("l_suppkey").alias("station"), day.alias("day_type"), (F.col("l_partkey") * 7 % 24).alias("hour"), F.col("l_quantity").cast("long").alias("tap_in"), F.floor(F.col("l_quantity") * (1 - F.col("l_discount")) + 0.5).cast("long").alias("tap_out"))

    def lattice(self, width: int = 40) -> DataFrame:
        k = F.col("p_partkey")
        n = self.part.agg(F.max("p_partkey").alias("top"))
        arms = self.part.select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("dir"))
        end = F.when(F.col("dir") == 0, k + 1).otherwise(k + width)
        length = F.when(F.col("dir") == 0, 200 + k * 37 % 811).otherwise(200 + k * 53 % 811)
        rows = arms.crossJoin(F.broadcast(n)).select((2 * k + F.col("dir")).alias("edge_id"), k.alias("u"), end.alias("v"), length.alias("length"), ((k * 53 + 17 * F.col("dir")) % 101).alias("shade_pct"), "dir", "top")
        return rows.filter("v <= top").filter(f"not (dir = 0 and (u + 1) % {width} = 0)").drop("top", "dir")

    def pixels(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.orders.select(k.alias("id"), F.floor(k / 100).cast("long").alias("row"), (k % 100).alias("col"), (k * 31 % 13).alias("class"), (F.col("o_custkey") % 24).alias("hour"), (k * 17 % 23 - 2).alias("dem"), (k * 29 % 101).alias("lit_pct"), (k * 7919 % 64).alias("flags"))

    def detections(self) -> DataFrame:
        d = F.col("doc_id")
        rows = self.documents.select("doc_id", "lang").join(self.labels, "doc_id")
        return rows.select("doc_id", "lang", ((d * 7919 % 1000) / 1000.0).alias("score"), F.col("quality").cast("int").alias("truth"), (1 + d % 3).alias("tier"), F.floor(d / 4).cast("long").alias("grp"))

    def intervals(self) -> DataFrame:
        start = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long")
        return self.orders.select(F.col("o_custkey").alias("key"), "o_orderkey", start.alias("start"), (start + F.col("o_orderkey") % 60).alias("end"))

    def slots(self) -> DataFrame:
        return self.events.select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"), "event_id", "event_type", "value", (F.col("value") > 50).alias("flag"))


#: The same as sub-selects.
SQL = {
    "buildings": "(select c_custkey as id, c_custkey * 7919 % 4000 as x, c_custkey * 10427 % 3000 as y, c_mktsegment as archetype, 100 + c_custkey * 37 % 900 as gfa from customer)",
    "stations": "(select s_suppkey as id, s_suppkey * 6151 % 4000 as x, s_suppkey * 3571 % 3000 as y, case when s_suppkey % 10 = 0 then 'MRT' else 'BUS' end as source, cast(case when s_suppkey % 10 = 0 then 800 else 400 end as bigint) as cutoff from supplier)",
    "rides": "(select l_suppkey as station, case when isodow(l_shipdate) >= 6 then 'WEEKENDS/HOLIDAY' else 'WEEKDAY' end as day_type, l_partkey * 7 % 24 as hour, cast(l_quantity as bigint) as tap_in, cast(floor(l_quantity * (1 - l_discount) + 0.5) as bigint) as tap_out from lineitem)",
    "lattice": "(select * from (select 2 * k + dir as edge_id, k as u, case when dir = 0 then k + 1 else k + 40 end as v, case when dir = 0 then 200 + k * 37 % 811 else 200 + k * 53 % 811 end as length, (k * 53 + 17 * dir) % 101 as shade_pct, dir from (select p_partkey as k, unnest([0, 1]) as dir from part)) where v <= (select max(p_partkey) from part) and not (dir = 0 and (u + 1) % 40 = 0))",
    "pixels": "(select o_orderkey as id, o_orderkey // 100 as row, o_orderkey % 100 as col, o_orderkey * 31 % 13 as class, o_custkey % 24 as hour, o_orderkey * 17 % 23 - 2 as dem, o_orderkey * 29 % 101 as lit_pct, o_orderkey * 7919 % 64 as flags from orders)",
    "detections": "(select doc_id, lang, (doc_id * 7919 % 1000) / 1000.0::double as score, cast(quality as int) as truth, 1 + doc_id % 3 as tier, doc_id // 4 as grp from documents join labels using (doc_id))",
    "intervals": "(select o_custkey as key, o_orderkey, datediff('day', date '1990-01-01', cast(o_orderdate as date)) as start, datediff('day', date '1990-01-01', cast(o_orderdate as date)) + o_orderkey % 60 as \"end\" from orders)",
    "slots": "(select user_id, cast(floor(epoch(ts)) as bigint) as at_s, event_id, event_type, value, value > 50 as flag from events)",
}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables as a query; {binding} in its SQL stands for that sub-select."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            text = sql
            for k, v in SQL.items():
                text = text.replace("{" + k + "}", v)
            ORACLES[name] = text
        return fn

    return register


def rnd(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
