"""Benchmark decontamination (operator 1): winnowing, in DataFrame functions only.

Of every `window - k + 1` consecutive k-grams the least hash is a fingerprint of its text. Any `window` words that a document
shares with a benchmark item hold one k-gram that both select, so joining fingerprints finds every shared window; each
hit is then extended to the windows round it, whose words are compared in full. Items shorter than a window are one
fingerprint of their whole length. Document rows are never shuffled with their text: hits are found, extended and compared
beside the scan, and only (document, position) rows are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BREAK, cut, lowered, table

K = 5
#: Benchmark windows up to which their side is broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 400_000
#: Contaminated rows up to which their ids are broadcast to the documents; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(lowered(text), BREAK), ""), F.array().cast("array<string>"))


def _joined(words: str, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def _steps(n: Column) -> Column:
    """1..n, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _with_grams(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("n", F.size("words")).withColumn("grams", F.transform(_steps(F.col("n") - (k - 1)), lambda i: F.xxhash64(F.slice("words", i, k))))


def _selected(k: int, window: int) -> Column:
    """The least k-gram hash of each window, without repeats."""
    span = window - k + 1
    return F.array_distinct(F.transform(_steps(F.size("grams") - (span - 1)), lambda i: F.array_min(F.slice("grams", i, span))))


def _prints(k: int, window: int, short: list[int]) -> Column:
    """(fp, len) of a text: the winnowed k-grams for full windows, and every window of each short length."""
    out = F.transform(_selected(k, window), lambda h: F.struct(h.alias("fp"), F.lit(window).alias("len")))
    for n in short:
        out = F.concat(out, _whole(n))
    return out


def _whole(n: int) -> Column:
    """(fp, len) of every window of n words."""
    return F.array_distinct(F.transform(_steps(F.col("n") - (n - 1)), lambda i: F.struct(F.xxhash64(_joined("words", i, n)).alias("fp"), F.lit(n).alias("len"))))


def hits(docs: DataFrame, items: DataFrame, window: int = 10, k: int = K) -> DataFrame:
    """One row per different row of docs (doc_id, text): doc_id, of (xxhash64 of the text), n_words, rows (how many such rows),
    spans (array of start, end), items (array of item ids as text).

    spans: each occurrence of an item's window, 1-based and inclusive word positions. See decontaminate() for odd cases.
    """
    # explode_outer, as explode would push a filter on its whole array expression below the projections that share its parts
    bench = _with_grams(items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")), k).filter("n > 0")
    bench = bench.withColumn("len", F.least("n", F.lit(window)))
    windows = (
        bench.select("item", "len", F.explode_outer(F.transform(_steps(F.col("n") - F.col("len") + 1), lambda i: F.array_join(F.slice("words", i, F.col("len")), " "))).alias("win"))
        .filter("win is not null").groupBy("win").agg(F.collect_set("item").alias("found"))
    )
    short = sorted(r[0] for r in bench.filter(F.col("n") < window).select("n").distinct().collect())  # below window, so few
    prints = bench.select(F.col("len").alias("own"), F.explode_outer(_prints(k, window, short)).alias("p")).select("own", "p.fp", F.col("p.len").alias("len")).filter("fp is not null and len = own").select("fp", "len").distinct()
    small = windows.count() <= BROADCAST_WINDOWS
    docs = _with_grams(docs.select("doc_id", F.xxhash64("text").alias("of"), words_of(F.col("text")).alias("words")), k)
    wide = ["doc_id", "of", "n", "words", "grams"]
    none = F.array(F.struct(F.lit(None).cast("long").alias("fp"), F.lit(0).alias("len")))  # keeps a row for each document
    if small:
        exploded = docs.withColumn("prints", F.concat(none, _prints(k, window, short))).select(*wide, F.explode_outer("prints").alias("p"))
        joined = exploded.select(*wide, "p.fp", F.col("p.len").alias("len")).join(F.broadcast(prints.withColumn("hit", F.lit(True))), ["fp", "len"], "left")
        found = joined.filter("hit or fp is null")
    else:  # only keys and fingerprints are shuffled, and each document's hits are joined back to it
        keys = docs.withColumn("prints", _prints(k, window, short)).select("doc_id", "of", F.explode_outer("prints").alias("p")).select("doc_id", "of", "p.fp", F.col("p.len").alias("len"))
        own = keys.join(prints, ["fp", "len"]).groupBy(F.col("doc_id").alias("own_id"), F.col("of").alias("own_of")).agg(F.collect_set(F.struct("fp", "len")).alias("hits"))
        back_to = docs.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("of").eqNullSafe(F.col("own_of")), "left")
        found = back_to.select(*wide, F.explode_outer(F.concat(none, F.coalesce("hits", F.slice(none, 1, 0)))).alias("p")).select(*wide, "p.fp", F.col("p.len").alias("len"))
    back = window - k
    around = F.flatten(F.transform(
        F.filter(_steps(F.size("grams")), lambda i: F.element_at("grams", i) == F.col("fp")),
        lambda i: F.sequence(F.greatest(F.lit(1), i - back), F.least(i, F.col("n") - (window - 1))),
    ))
    starts = F.when(F.col("fp").isNull(), F.array().cast("array<int>")).when(F.col("len") == window, around).otherwise(_steps(F.col("n") - F.col("len") + 1))
    rows = (
        found.withColumn("starts", starts)
        .select("doc_id", "of", "n", "fp", "len", F.explode_outer(F.transform(F.array_distinct("starts"), lambda s: F.struct(s.alias("start"), F.array_join(F.slice("words", s, F.col("len")), " ").alias("win")))).alias("w"))
        .select("doc_id", "of", "n", "fp", "len", "w.start", "w.win")
    )
    if small:
        spans = rows.join(F.broadcast(windows), "win", "left").filter("found is not null or fp is null")
    else:  # the rows that only stand for their document have no window, and would all meet at null
        spans = rows.join(windows, "win").unionByName(rows.filter("fp is null").withColumn("found", F.lit(None).cast("array<string>")))
    return (
        spans.groupBy("doc_id", "of").agg(
            F.max("n").cast("long").alias("n_words"),
            F.count_if(F.col("fp").isNull()).alias("rows"),
            F.collect_set(F.when(F.col("found").isNotNull(), F.struct("start", (F.col("start") + F.col("len") - 1).alias("end")))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("found"))).alias("items"),
        )
        .select("doc_id", "of", "n_words", "rows", F.array_sort("spans").alias("spans"), F.array_sort("items").alias("items"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, k: int = K) -> DataFrame:
    """The rows of docs that share no window with any item. Rows without an id are told apart by their text."""
    bad = cut(hits(docs, items, window, k).filter(F.size("spans") > 0).select(F.col("doc_id").alias("bad_id"), F.col("of").alias("bad_of")))
    side = F.broadcast if bad.count() <= BROADCAST_ROWS else (lambda df: df)
    return docs.join(side(bad), F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_of")), "left_anti")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit (words inside shared windows), n_items, items_sha256, contaminated; one row per row of docs.

    docs: doc_id, text; items: item_id, text. A null or wordless text has no words and is clean; a wordless item has no window;
    a null item_id matches no name and is left out of the items, though its windows count. Repeated rows each give a row;
    a null doc_id stays null; other columns are ignored; an empty table on either side gives no rows, or clean ones.
    """
    h = hits(docs, items, window, k).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    state = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", state, lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["start"] - 1))).alias("n")), lambda s: s["n"])
    return h.select(
        "doc_id", "n_words", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents
), b as (
  select cast(item_id as varchar) as item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark
), bw as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as win
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), dw as (
  select r, n, i, array_to_string(w[i : i + n - 1], ' ') as win
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join (select distinct n from bw) where len(w) >= n)
), h as (select r, dw.n, i, item from dw join bw using (win)),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from h) group by r),
it as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from h) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join it using (r)
"""
