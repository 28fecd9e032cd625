"""Order-dependent operators: runs, intervals, ranks, sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.operators import evaluate as E
from penumbra.operators import islands as I
from penumbra.plans.base import Tables, query, rnd

STEPS = [(k, until, v) for k in range(3) for until, v in ((540, 0.1 + k), (1050, 0.9 + k), (1440, 0.2 + k))]


@query("w03_step_expand", "select cast(k as bigint) as k, h as hour, case when h < 9 then 0.1::double + k when h < 18 then 0.9::double + k else 0.2::double + k end as v from (select unnest([0, 1, 2]) as k) cross join (select cast(unnest(range(0, 24)) as int) as h)")
def w03(t: Tables) -> DataFrame:
    return I.step_hours(t.rows("k long, until int, v double", *STEPS), ["k"], "until", "v")


ORD = "(partition by user_id order by at_s, event_id)"
RLE = f"(select *, sum(case when new then 1 else 0 end) over {ORD} as island from (select *, row_number() over {ORD} - 1 as pos, coalesce(lag(flag) over {ORD} is distinct from flag, true) as new from {{slots}}))"
RUNS = f"(select user_id, cast(island as bigint) as island, any_value(flag) as flag, count(*) as n, min(pos) as first_at, max(pos) as last_at from {RLE} group by user_id, island)"
KEYS, ORDER = ["user_id"], ["at_s", "event_id"]


@query("w04_rle", f"select user_id, island, flag, n, first_at, last_at from {RUNS}")
def w04(t: Tables) -> DataFrame:
    r = I.run_lengths(t.slots(), KEYS, ORDER, "flag")
    return r.select("user_id", "island", "flag", "n", F.col("first_at").cast("long").alias("first_at"), F.col("last_at").cast("long").alias("last_at"))


@query("w05_run_round", f"select user_id, n, first_at from {RUNS} where flag and 10 between first_at and last_at")
def w05(t: Tables) -> DataFrame:
    r = I.run_round(t.slots().withColumn("target", F.lit(10)), KEYS, ORDER, "flag", "target")
    return r.select("user_id", "n", F.col("first_at").cast("long").alias("first_at"))


@query("w06_true_runs", f"select user_id, island, n from {RUNS} where flag and n >= 2")
def w06(t: Tables) -> DataFrame:
    return I.true_runs(t.slots(), KEYS, ORDER, "flag", 2).select("user_id", "island", "n")


MERGED = "(select key, island, min(start) as start, max(\"end\") as \"end\" from (select *, sum(case when prev is null or start > prev then 1 else 0 end) over (partition by key order by start, \"end\" rows unbounded preceding) as island from (select *, max(\"end\") over (partition by key order by start, \"end\" rows between unbounded preceding and 1 preceding) as prev from {intervals})) group by key, island)"


@query("w07_interval_union", f"select key, cast(sum(\"end\" - start) as bigint) as covered from {MERGED} group by key")
def w07(t: Tables) -> DataFrame:
    return I.covered_length(t.intervals(), ["key"], "start", "end")


@query("w07_merged_intervals", f"select key, start, \"end\" from {MERGED}")
def w07b(t: Tables) -> DataFrame:
    return I.merged_intervals(t.intervals(), ["key"], "start", "end").select("key", "start", "end")


@query("w08_cumulative", "select edge_id, cast(sum(length) over (partition by u // 40 order by edge_id rows unbounded preceding) - length as bigint) as from_at, cast(sum(length) over (partition by u // 40 order by edge_id rows unbounded preceding) as bigint) as to_at from {lattice}")
def w08(t: Tables) -> DataFrame:
    e = t.lattice().withColumn("line", F.floor(F.col("u") / 40))
    return I.cumulative(e, ["line"], ["edge_id"], "length").select("edge_id", "from_at", "to_at")


@query("w08_locate", "select line, edge_id from (select u // 40 as line, edge_id, sum(length) over (partition by u // 40 order by edge_id rows unbounded preceding) as t, length from {lattice}) where t - length <= 5000 and t > 5000")
def w08b(t: Tables) -> DataFrame:
    e = t.lattice().withColumn("line", F.floor(F.col("u") / 40).cast("long"))
    return I.locate(e, ["line"], ["edge_id"], "length", F.lit(5000)).select("line", "edge_id")


@query("w09_longest_run", "select line, cast(max(run) as bigint) as longest from (select line, island, sum(case when sunny then length else 0 end) as run from (select *, sum(case when new then 1 else 0 end) over (partition by line order by edge_id) as island from (select u // 40 as line, edge_id, length, shade_pct < 50 as sunny, coalesce(lag(shade_pct < 50) over (partition by u // 40 order by edge_id) is distinct from (shade_pct < 50), true) as new from {lattice})) group by line, island) group by line")
def w09(t: Tables) -> DataFrame:
    e = t.lattice().withColumn("line", F.floor(F.col("u") / 40).cast("long")).withColumn("sunny", F.col("shade_pct") < 50)
    return I.longest_run(e, ["line"], ["edge_id"], "sunny", "length").select("line", F.col("longest").cast("long").alias("longest"))


@query("w10_topk_per_cell", "select id, row_number() over (order by gfa desc, id) as rank from (select *, row_number() over (partition by x // 800, y // 800 order by gfa desc, id) as k from {buildings}) where k = 1 qualify rank <= 14")
def w10(t: Tables) -> DataFrame:
    return E.first_per_cell(t.buildings(), 800, 14, F.desc("gfa"), "id").select("id", F.col("rank").cast("long").alias("rank"))


@query("w11_keep_last", "select user_id, event_type, arg_max(event_id, (at_s, event_id)) as event_id from {slots} group by user_id, event_type")
def w11(t: Tables) -> DataFrame:
    return I.keep_one(t.slots(), ["user_id", "event_type"], F.desc("at_s"), F.desc("event_id")).select("user_id", "event_type", "event_id")


@query("w12_keep_shortest", "select a, b, arg_min(edge_id, (length, edge_id)) as edge_id from (select least(u, v) % 300 as a, greatest(u, v) % 300 as b, length, edge_id from {lattice}) where a <> b group by a, b")
def w12(t: Tables) -> DataFrame:
    from penumbra.operators.graph import reduce_parallel

    e = t.lattice().select("edge_id", (F.least("u", "v") % 300).alias("a"), (F.greatest("u", "v") % 300).alias("b"), "length")
    # (a, b) is kept apart from (b, a) here, so the pair is named by one number
    named = e.select("edge_id", "length", "a", "b", (F.col("a") * 1000 + F.col("b")).alias("u"), F.lit(-1).cast("long").alias("v")).filter("a <> b")
    return reduce_parallel(named).select("a", "b", "edge_id")


LINES = "(select id // 6 as line, id, x, y from {buildings})"


@query("w13_turn_angle", f"select id, round(degrees(acos(greatest(-1.0::double, least(1.0::double, (ax * bx + ay * by_) / (sqrt(cast(ax * ax + ay * ay as double)) * sqrt(cast(bx * bx + by_ * by_ as double))))))) + 0 * (ax * bx), 3) as turn from (select id, x - lag(x) over w as ax, y - lag(y) over w as ay, lead(x) over w - x as bx, lead(y) over w - y as by_ from {LINES} window w as (partition by line order by id))")
def w13(t: Tables) -> DataFrame:
    b = t.buildings().withColumn("line", F.floor(F.col("id") / 6))
    return I.turns(b, ["line"], "id").select("id", rnd("turn", 3).alias("turn"))


@query("w14_gap", "select key, o_orderkey, lead(start) over (partition by key order by start, \"end\", o_orderkey) - \"end\" as gap from {intervals}")
def w14(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("start", "end", "o_orderkey")
    return t.intervals().select("key", "o_orderkey", (F.lead("start").over(w) - F.col("end")).alias("gap"))


@query("w16_drop_repeats", f"select user_id, event_id from (select *, lag(event_type) over {ORD} as before from {{slots}}) where before is distinct from event_type")
def w16(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("at_s", "event_id"))
    return t.slots().withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col("event_type"))).select("user_id", "event_id")


@query("w17_threshold_timer", f"select user_id, event_id, case when flag then at_s - first_value(at_s) over (partition by user_id, island order by at_s, event_id) else 0 end as held from {RLE}")
def w17(t: Tables) -> DataFrame:
    return I.over_threshold(t.slots(), KEYS, ORDER, "at_s", "value", 50).select("user_id", "event_id", F.col("held").cast("long").alias("held"))


@query("t01_topk", "select station, cast(sum(tap_in) as bigint) as total from {rides} where day_type = 'WEEKDAY' group by station order by total desc, station limit 10")
def t01(t: Tables) -> DataFrame:
    return t.rides().filter("day_type = 'WEEKDAY'").groupBy("station").agg(F.sum("tap_in").alias("total")).orderBy(F.desc("total"), "station").limit(10)


@query("t02_sorted", "select id, gfa, row_number() over (order by gfa desc, id) as rank from {buildings}")
def t02(t: Tables) -> DataFrame:
    from penumbra.operators.graph import renumber

    keyed = t.buildings().select("id", "gfa", (F.lit(10**12) - F.col("gfa") * 10**8 + F.col("id")).cast("long").alias("key"))
    return keyed.join(renumber(keyed, "key"), "key").select("id", "gfa", (F.col("number") + 1).cast("long").alias("rank"))


@query("t03_hard_negative", "select doc_id, round(score * (1 - strict), 6) as hardness, row_number() over (order by round(score * (1 - strict), 6) desc, doc_id) as rank from (select doc_id, score, (doc_id * 104729 % 1000) / 1000.0::double as strict from {detections}) where strict < 0.5 order by hardness desc, doc_id limit 25")
def t03(t: Tables) -> DataFrame:
    d = t.detections().withColumn("strict", F.col("doc_id") * 104729 % 1000 / 1000.0).filter("strict < 0.5")
    h = d.select("doc_id", F.round(F.col("score") * (1 - F.col("strict")), 6).alias("hardness"))
    return E.top_ranked(h, 25, F.desc("hardness"), "doc_id").withColumn("rank", F.col("rank").cast("long"))


@query("t04_bottom", "select doc_id, score from {detections} order by score, doc_id limit 20")
def t04(t: Tables) -> DataFrame:
    return t.detections().select("doc_id", "score").orderBy("score", "doc_id").limit(20)


@query("t05_hashed_sample", "select id, archetype from (select *, row_number() over (partition by archetype order by md5(cast(id as varchar) || ':7'), id) as k from {buildings}) where k <= 5")
def t05(t: Tables) -> DataFrame:
    return E.hashed_sample(t.buildings(), 5, "id", 7, "archetype").select("id", "archetype")


@query("t06_lexicographic_pick", "select u, arg_min(edge_id, (shade_pct < 50, length, edge_id)) as edge_id from {lattice} group by u")
def t06(t: Tables) -> DataFrame:
    return t.lattice().groupBy("u").agg(F.min_by("edge_id", F.struct(F.col("shade_pct") < 50, "length", "edge_id")).alias("edge_id"))


@query("t07_stable_order", "select id, row_number() over (order by gfa, id) - 1 as \"at\" from {buildings}")
def t07(t: Tables) -> DataFrame:
    from penumbra.operators.graph import renumber

    keyed = t.buildings().select("id", (F.col("gfa") * 10**9 + F.col("id")).alias("key"))
    return keyed.join(renumber(keyed, "key"), "key").select("id", F.col("number").cast("long").alias("at"))


@query("t08_top_components", "select u // 40 as comp, cast(sum(length) as bigint) as length from {lattice} group by 1 order by length desc, comp limit 10")
def t08(t: Tables) -> DataFrame:
    return t.lattice().groupBy(F.floor(F.col("u") / 40).cast("long").alias("comp")).agg(F.sum("length").alias("length")).orderBy(F.desc("length"), "comp").limit(10)


@query("t09_best_per_group", "select o_custkey, o_orderstatus, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as o_orderkey from orders group by 1, 2")
def t09(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("t10_two_stage", "select doc_id, row_number() over (order by again desc, doc_id) as rank from (select doc_id, (doc_id * 31 % 977) as again from (select * from {detections} order by score desc, doc_id limit 200)) order by again desc, doc_id limit 50")
def t10(t: Tables) -> DataFrame:
    pool = t.detections().orderBy(F.desc("score"), "doc_id").limit(200).select("doc_id", (F.col("doc_id") * 31 % 977).alias("again"))
    return E.top_ranked(pool, 50, F.desc("again"), "doc_id").select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("n25_renumber", "select node, row_number() over (order by node) - 1 as number from (select distinct u * 3 % 1009 as node from {lattice})")
def n25(t: Tables) -> DataFrame:
    from penumbra.operators.graph import renumber

    return renumber(t.lattice().select((F.col("u") * 3 % 1009).alias("node")), "node").withColumn("number", F.col("number").cast("long"))
