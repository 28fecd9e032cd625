"""SimHash near-duplicates (operator 4).

Fingerprints that are equal collapse first. Two fingerprints within the radius agree in some choice of blocks (pigeonhole),
so the distinct ones are dealt to buckets by the bits of each choice. Inside a bucket they are compared bit-sliced: one
bit plane of every 64 is a packed vertical bitmap, carry-save counters add up the differing planes for many pairs at once,
and a block is left as soon as all its pairs exceed the radius. Buckets give spanning stars, never all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penumbra.operators.graph import connected_components as components

from .common import bounded, cut, parts, table

#: Fingerprints of a bucket that one task compares with each other, or with as many of another chunk.
CHUNK = 512
#: (blocks, blocks that must agree beyond the radius, distinct fingerprints up to which that choice is used). All are exact.
PLANS = ((5, 1, 1 << 21), (6, 2, 1 << 27), (7, 3, 1 << 33), (8, 4, 1 << 62))


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64 bits: bit i is set if it is set in over half of the XXH64 of the word shingles (repeats count)."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    h = np.fromiter((xxh64_intdigest(b" ".join(w[i : i + words]), seed) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def near_links(fps: np.ndarray, radius: int = 4) -> np.ndarray:
    """(m, m) booleans: i < j and their fingerprints differ in at most radius bits; bit-sliced, with blocks abandoned early."""
    m = len(fps)
    words = (m + 63) // 64
    padded = np.zeros(words * 64, np.uint64)
    padded[:m] = fps
    bits = ((padded[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)  # 64 planes of one bit per member
    out = np.zeros((m, m), bool)
    for at in range(0, m, 256):  # queries of this block against all members from the same word on
        rows = np.arange(at, min(at + 256, m))
        first = at // 64
        later = np.arange(first * 64, words * 64)[None, :] > rows[:, None]
        later[:, max(0, m - first * 64):] = False
        alive = np.packbits(later, axis=1, bitorder="little").view(np.uint64)
        flip = np.where(bits[:, rows] == 1, ~np.uint64(0), np.uint64(0))
        counters = [np.zeros_like(alive) for _ in range(max(1, radius.bit_length()))]
        for p in range(64):
            carry = planes[p, first:][None, :] ^ flip[p][:, None]
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            alive &= ~(carry | _over(counters, radius))
            if p % 4 == 3 and not alive.any():
                break
        else:
            out[rows, first * 64 :] = np.unpackbits(alive.view(np.uint8), axis=1, bitorder="little")[:, : m - first * 64].astype(bool)
    return out


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the bit-sliced count exceeds radius."""
    over, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same = same & counters[k]
        else:
            over = over | (same & counters[k])
            same = same & ~counters[k]
    return over


def stars(linked: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """For each component of the link matrix, pairs of its least fingerprint (as signed) with its others."""
    linked = linked | linked.T
    left, signed, out = linked.any(1), fps.view(np.int64), []
    for i in np.flatnonzero(left):
        if not left[i]:
            continue
        seen = np.zeros(len(fps), bool)
        front = np.zeros(len(fps), bool)
        front[i] = True
        while front.any():
            seen |= front
            front = linked[front].any(0) & ~seen
        left &= ~seen
        got = np.unique(signed[seen])
        out += [(int(got[0]), int(x)) for x in got[1:]]
    return out


def bucket_links(radius: int):
    """Streams rows sorted by bucket; whole buckets are packed into blocks of about CHUNK members, compared and left as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            fps = np.unique(fps)
            if len(fps) > 1 and (links := stars(near_links(fps, radius), fps)):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        held_k, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            held_k = np.concatenate([held_k, b.column(0).to_numpy(zero_copy_only=False)])
            held = np.concatenate([held, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            ends = np.flatnonzero(held_k[1:] != held_k[:-1]) + 1  # the last bucket may go on
            start = 0
            while start < (ends[-1] if len(ends) else 0):
                fit = ends[(ends > start)]
                within = fit[fit <= start + CHUNK]
                end = int(within[-1] if len(within) else fit[0])
                yield from flush(held[start:end])
                start = end
            held_k, held = held_k[start:], held[start:]
        yield from flush(held)

    return run


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, hash, fp) for each row of docs; hash is that of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words, seed) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "hash", "fp"])

    return bounded(docs).select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, fp long")


def links(distinct: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """Stars (a, b) that join whatever distinct fingerprints (column fp) lie within the radius of each other; n: their number."""
    blocks, agree = next((radius + a, a) for _, a, most in PLANS if n <= most)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in pick) for pick in combinations(range(blocks), agree)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = (
        keyed.join(sizes, "key")
        .withColumn("chunks", chunks)
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .select("fp", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "fp")
    )
    spark = distinct.sparkSession
    return dealt.repartition(parts(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(bucket_links(radius), "a long, b long")


def classes(fp: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, low, root) of each different fingerprint of fp (doc_id, hash, fp): its least doc_id and its component."""
    distinct = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("low")))
    joined = cut(links(distinct.select("fp"), distinct.count(), radius))
    roots = components(joined)
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    fingerprint: 16 lowercase hex digits; component_id: the least doc_id that is reachable over links of at most radius
    differing bits. A null or empty text has the fingerprint zero and links like any other. A null doc_id stays null and
    is no component_id unless its component has nothing else. Repeated rows each give a row. Other columns are ignored; an
    empty table gives no rows.
    """
    fp = cut(fingerprints(docs, words, seed))
    found = classes(fp, radius)
    # cut, so that both sides of the join are exchanged and a component of very many fingerprints can be split
    least = cut(found.groupBy("root").agg(F.min("low").alias("component_id")))
    of = found.join(least, "root").select("fp", "component_id")
    return fp.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row of docs (doc_id, text) for each near-duplicate group: that of the least doc_id, a null one last, then of the least hash of the text.

    Rows are told apart by id and text: those of one id in different groups each stay for theirs, and of rows equal in both one
    stays. Null and empty texts are one group. Other columns are kept; an empty table gives no rows.
    """
    fp = cut(fingerprints(docs))
    of = classes(fp, radius).select("fp", "root")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash")
    # the least of each fingerprint first, as fingerprints may be many in a group and rows many in a fingerprint
    kept = fp.groupBy("fp").agg(F.min(place).alias("place")).join(of, "fp").groupBy("root").agg(F.min("place").alias("place"))
    kept = kept.select(F.col("place.doc_id").alias("__id"), F.col("place.hash").alias("__hash"))
    rows = docs.join(kept, docs.doc_id.eqNullSafe(F.col("__id")) & (F.xxhash64(docs.text) == F.col("__hash")), "left_semi")
    if fp.groupBy("doc_id", "hash").count().filter("count > 1").isEmpty():
        return rows
    one = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    return rows.withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__n")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
