"""Classifier evaluation and model support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.functions import scalars as X
from penumbra.operators import evaluate as E
from penumbra.plans.base import Tables, query, rnd

COUNTS = "count(*) filter (where p and q) as tp, count(*) filter (where p and not q) as fp, count(*) filter (where not p and q) as fn, count(*) filter (where not p and not q) as tn"
RATES = "tp, fp, fn, tn, round(tp / cast(greatest(tp + fp, 1) as double), 6) as precision, round(tp / cast(greatest(tp + fn, 1) as double), 6) as recall, round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round((tp + tn) / cast(greatest(tp + fp + fn + tn, 1) as double), 6) as accuracy, round(tp / cast(greatest(tp + fp + fn, 1) as double), 6) as iou"
TIERED = "(select *, case tier when 1 then 0.4::double when 2 then 0.6 else 0.8 end as thr from {detections})"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "accuracy", "iou")})


@query("p11_candidate_any", f"select doc_id, bool_or(score >= thr) over (partition by grp) as candidate, bool_or(score >= thr) over (partition by grp) and score >= 0.45 as positive from {TIERED}")
def p11(t: Tables) -> DataFrame:
    look = F.broadcast(t.rows("tier long, thr double", (1, 0.4), (2, 0.6), (3, 0.8)))  # fixed: one row for each tier
    d = E.any_over(t.detections().join(look, "tier"), "grp", "score", F.col("thr"))
    return d.select("doc_id", "candidate", (F.col("candidate") & (F.col("score") >= 0.45)).alias("positive"))


@query("a24_confusion", f"select tier, {RATES} from (select tier, {COUNTS} from (select tier, score >= 0.5 as p, truth = 1 as q from {{detections}}) group by tier)")
def a24(t: Tables) -> DataFrame:
    return _rounded(E.confusion(t.detections(), F.col("score") >= 0.5, F.col("truth") == 1, "tier"))


@query("a25_macro_means", "select round(avg(acc), 6) as acc, round(avg(case when n > 2 then acc end), 6) as acc_filled from (select grp, sum(truth) as n, avg(case when (score >= 0.5) = (truth = 1) then 1.0::double else 0 end) as acc from {detections} group by grp)")
def a25(t: Tables) -> DataFrame:
    hit = F.avg(F.when((F.col("score") >= 0.5) == (F.col("truth") == 1), 1.0).otherwise(0.0))
    m = E.macro(t.detections().groupBy("grp").agg(F.sum("truth").alias("n"), hit.alias("acc")), F.col("n") > 2, "acc")
    return m.select(F.round("acc", 6).alias("acc"), F.round("acc_filled", 6).alias("acc_filled"))


THRESHOLDS = [round(0.1 + 0.025 * k, 3) for k in range(33)]
TH_SQL = "(select unnest([" + ", ".join(map(str, THRESHOLDS)) + "]::double[]) as threshold)"
SWEEP = f"(select threshold, {RATES} from (select threshold, {COUNTS} from (select threshold, score >= threshold as p, truth = 1 as q from {{detections}} cross join {TH_SQL}) group by threshold))"


@query("a26_threshold_sweep", f"select * from {SWEEP}")
def a26(t: Tables) -> DataFrame:
    return _rounded(E.threshold_sweep(t.detections(), "score", F.col("truth") == 1, THRESHOLDS))


@query("a26_best_threshold", f"select arg_max(threshold, (f1, -threshold)) as threshold, max(f1) as f1 from {SWEEP}")
def a26b(t: Tables) -> DataFrame:
    return E.best_threshold(_rounded(E.threshold_sweep(t.detections(), "score", F.col("truth") == 1, THRESHOLDS)))


@query("a27_grid_sweep", "select o as overlap, a as aspect, count(*) filter (where lit_pct / 100.0::double >= o and class >= a) as kept, cast(coalesce(sum(dem) filter (where lit_pct / 100.0::double >= o and class >= a), 0) as bigint) as dem from {pixels} cross join (select unnest([0.1, 0.3, 0.5, 0.7]::double[]) as o) cross join (select unnest([2, 5, 8]) as a) group by o, a")
def a27(t: Tables) -> DataFrame:
    grid = t.pixels().select("class", "dem", "lit_pct", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.3, 0.5, 0.7)])).alias("overlap")).select("*", F.explode(F.array(*[F.lit(x) for x in (2, 5, 8)])).alias("aspect"))
    keep = (F.col("lit_pct") / 100.0 >= F.col("overlap")) & (F.col("class") >= F.col("aspect"))
    return grid.groupBy("overlap", "aspect").agg(F.count_if(keep).alias("kept"), F.coalesce(F.sum(F.when(keep, F.col("dem"))), F.lit(0)).alias("dem"))


@query("a35_set_jaccard", "select count(*) filter (where a and b) as both, count(*) filter (where a and not b) as only_a, count(*) filter (where b and not a) as only_b, round(count(*) filter (where a and b) / cast(count(*) filter (where a or b) as double), 6) as jaccard from (select score >= 0.4 as a, truth = 1 as b from {detections})")
def a35(t: Tables) -> DataFrame:
    d = t.detections()
    return E.set_metrics(d.filter("score >= 0.4").select("doc_id"), d.filter("truth = 1").select("doc_id")).withColumn("jaccard", F.round("jaccard", 6))


@query("a36_group_recall", "select lang, round(avg(case when truth = 1 then case when score >= 0.5 then 1.0::double else 0 end end), 6) as recall, round(avg(case when truth = 0 then case when score < 0.5 then 1.0::double else 0 end end), 6) as rejection from {detections} group by lang")
def a36(t: Tables) -> DataFrame:
    on = lambda k, hit: F.round(F.avg(F.when(F.col("truth") == k, F.when(hit, 1.0).otherwise(0.0))), 6)
    return t.detections().groupBy("lang").agg(on(1, F.col("score") >= 0.5).alias("recall"), on(0, F.col("score") < 0.5).alias("rejection"))


@query("a42_macro_nonempty", "select round(avg(dice), 6) as dice, round(avg(case when n_truth > 0 then dice end), 6) as dice_filled from (select row, count(*) filter (where class >= 8) as n_truth, coalesce(2.0::double * count(*) filter (where lit_pct >= 50 and class >= 8) / nullif(count(*) filter (where lit_pct >= 50) + count(*) filter (where class >= 8), 0), 1) as dice from {pixels} group by row)")
def a42(t: Tables) -> DataFrame:
    m = E.macro(E.tile_overlap(t.pixels(), F.col("lit_pct") >= 50, F.col("class") >= 8, "row"), F.col("n_truth") > 0, "dice")
    return m.select(F.round("dice", 6).alias("dice"), F.round("dice_filled", 6).alias("dice_filled"))


@query("m03_tier_thresholds", "select tier, greatest(0.15::double, least(0.9::double, 0.5 + case tier when 1 then -0.15 when 2 then 0.08 else 0 end)) as thr from (select distinct tier from {detections})".replace("0.5 +", "0.5::double +").replace("-0.15", "-0.15::double").replace("0.08", "0.08::double"))
def m03(t: Tables) -> DataFrame:
    step = F.when(F.col("tier") == 1, -0.15).when(F.col("tier") == 2, 0.08).otherwise(0.0)
    return t.detections().select("tier").distinct().select("tier", E.tier_thresholds(F.lit(0.5), step, 0.15, 0.9).alias("thr"))


PROMPTS = [(k, [((k * 17 + j * 7) % 11 - 5) / 10 for j in range(64)]) for k in range(4)]
PROMPT_SQL = "(select * from (values " + ", ".join(f"({k}, {v}::double[])" for k, v in PROMPTS) + ") as p(k, v))"


@query("m04_softmax", f"select vec_id, round(e / sum(e) over (partition by vec_id), 5) as p, k from (select vec_id, k, exp(s - max(s) over (partition by vec_id)) as e from (select vec_id, k, 100 * list_dot_product(embedding::double[], v) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(v, v))) as s from embeddings cross join {PROMPT_SQL}))")
def m04(t: Tables) -> DataFrame:
    prompts = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for _, v in PROMPTS])
    unit = X.normalised(F.col("embedding"))
    scored = t.embeddings.select("vec_id", unit.alias("u")).select("vec_id", F.transform(prompts, lambda p: 100 * X.dot(F.col("u"), X.normalised(p))).alias("s"))
    return scored.select("vec_id", F.posexplode(X.softmax(F.col("s"))).alias("k", "q")).select("vec_id", F.round("q", 5).alias("p"), "k")


@query("m05_distance_band", "select id, case when d <= 12 * 12 and id % 360 < 50 then 1 when d >= 80 * 80 then 0 end as label from (select b.id, min((s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y)) as d from {buildings} b join {stations} s on (s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y) <= 200 * 200 group by b.id)")
def m05(t: Tables) -> DataFrame:
    from penumbra.operators.spatial import nearest

    near = t.stations().select(F.col("id").alias("station"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    n = nearest(t.buildings(), near, "id", "station", 200)
    return n.select("id", E.distance_band(F.sqrt(F.col("d2").cast("double")), F.col("id") % 360).alias("label"))


@query("m07_two_protocols", "select protocol, threshold, count(*) filter (where score >= threshold) as hits, count(*) as n from (select 'raw' as protocol, score from {detections} where truth = 1 union all select 'facing', score from {detections} where truth = 1 and tier = 1) cross join (select unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7]::double[]) as threshold) group by protocol, threshold")
def m07(t: Tables) -> DataFrame:
    pos = t.detections().filter("truth = 1")
    both = pos.select(F.lit("raw").alias("protocol"), "score").unionByName(pos.filter("tier = 1").select(F.lit("facing").alias("protocol"), "score"))
    th = F.explode(F.array(*[F.lit(x) for x in (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)])).alias("threshold")
    return both.select("protocol", "score", th).groupBy("protocol", "threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("hits"), F.count("*").alias("n"))


@query("m01_balanced_logistic")
def m01(t: Tables) -> DataFrame:
    """Coefficients of a balanced logistic probe on embeddings, label 0 against the rest."""
    data = t.embeddings.select("embedding", (F.col("label") == 0).cast("int").alias("y"))
    model = E.logistic_fit(data, "embedding", "y")
    return t.rows("k int, w double", *[(k, round(float(w), 4)) for k, w in enumerate(model.coefficients)])


@query("m02_cross_validated")
def m02(t: Tables) -> DataFrame:
    """Held-out probabilities of the probe by five folds of vec_id."""
    data = t.embeddings.select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"))
    return E.cross_validated(data, "embedding", "y", "vec_id").select("vec_id", "fold", rnd("prob").alias("prob"))
