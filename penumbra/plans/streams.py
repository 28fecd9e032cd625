"""Incremental forms, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.operators.tile_runs import tile_runs
from penumbra.plans.base import Tables, query
from penumbra.streaming import events as S


@query("x01_stream_dedup", "select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id, event_type")
def x01(t: Tables) -> DataFrame:
    stream = S.read_events(t.spark, t.sf_dir).withColumn("rank", F.struct("ts", "event_id"))
    last = stream.groupBy("user_id", "event_type").agg(F.max_by("event_id", "rank").alias("event_id"))
    return S.run_to_end(last, "complete")


@query("x02_hourly_windows", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n from events group by 1, 2")
def x02(t: Tables) -> DataFrame:
    counts = S.hourly_counts(S.read_events(t.spark, t.sf_dir), "ts", "event_type")
    return S.run_to_end(counts, "complete").select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("x02_tile_runs", "select s_suppkey as tile, case when s_suppkey % 3 = 0 then 'skip' when s_suppkey % 7 = 0 then 'ERR(exit1)' else 'done' end as status from supplier")
def x02b(t: Tables) -> DataFrame:
    """A job over tiles of which every third is finished and every seventh fails."""

    def work(row: dict) -> None:
        if row["tile"] % 7 == 0:
            raise SystemExit(1)

    tiles = t.supplier.select(F.col("s_suppkey").alias("tile"))
    return tile_runs(tiles, tiles.filter("tile % 3 = 0"), work).select("tile", "status")


@query("x06_threshold_timer", """select key, at_s, value, cast(case when value > 50 then at_s - min(case when value > 50 then at_s end) over (partition by key, island) else 0 end as bigint) as held
from (select *, sum(case when value > 50 then 0 else 1 end) over (partition by key order by at_s, value rows unbounded preceding) as island from (select cast(user_id as bigint) as key, cast(floor(epoch(ts)) as bigint) as at_s, cast(value as double) as value from events))""")
def x06(t: Tables) -> DataFrame:
    """Seconds above 50 for each event, with state kept per user."""
    return S.run_to_end(S.over_threshold(S.read_events(t.spark, t.sf_dir), "user_id", "ts", "value", 50))
