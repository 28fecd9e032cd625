"""Language identification (operator 6): multinomial naive Bayes over hashed character n-grams.

Counts of n-gram buckets by language are added up in Spark from a bounded sample of labelled documents; the matrix of log
probabilities (languages x buckets) is broadcast, and batches are scored by gathering its columns in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, crc_mod, table

BITS, ORDERS = 15, (1, 2, 3)
#: Labelled documents that the model is fitted on, about: more are thinned by a hash of their id.
SAMPLE = 50_000
#: Characters that are hashed and gathered at once.
CHARS = 400_000
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, and the position after each text's last."""
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in texts]
    out, ends, n = [], [], 0
    for c in codes:
        h = np.zeros(len(c), np.uint64)
        for k in range(1, max(ORDERS) + 1):
            if len(c) < k:
                break
            h = (h[: len(c) - k + 1] + c[k - 1 :] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if k in ORDERS:
                out.append((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS))
                n += len(out[-1])
        ends.append(n)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)).astype(np.int64), np.array(ends, np.int64)


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > CHARS or i + 1 == len(texts):
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """docs: doc_id, text, lang, rows to learn from. Returns the languages and log priors beside log probabilities (languages, 1 + buckets)."""
    docs = bounded(docs).filter("lang is not null and text is not null")
    n = docs.count()
    if n > sample:
        docs = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) < int(1e6 * sample / n) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            texts = b.column(0).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                c = counts.setdefault(lang, np.zeros(1 + (1 << BITS), np.int64))
                c[0] += len(own)
                for _, part in chunks(own):
                    c[1:] += np.bincount(grams(part)[0], minlength=1 << BITS)
        for lang, c in counts.items():
            i = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i)), pa.array(i), pa.array(c[i])], names=["lang", "bucket", "n"])

    got = docs.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), 1 + (1 << BITS)))
    at = {x: i for i, x in enumerate(langs)}
    rows = np.array([at[x] for x in got.column("lang").to_pylist()], np.int64)
    counts[rows, got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    model = np.zeros_like(counts)
    if langs:
        model[:, 0] = np.log(counts[:, 0] / counts[:, 0].sum())
        model[:, 1:] = np.log((counts[:, 1:] + 1) / (counts[:, 1:].sum(1, keepdims=True) + (1 << BITS)))
    return langs, model


def score(texts: list[str | None], langs: list[str], model: np.ndarray) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its posterior probability."""
    best, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if langs else []
    columns = np.ascontiguousarray(model[:, 1:])
    for start, part in chunks([texts[i] for i in known]):
        buckets, ends = grams(part)
        begins = np.concatenate([[0], ends[:-1]])
        logs = model[:, 0][:, None] + np.stack([np.add.reduceat(row[buckets], begins) for row in columns])
        logs -= logs.max(0)
        p = np.exp(logs)
        p /= p.sum(0)
        for k, i in enumerate(known[start : start + len(part)]):
            j = int(p[:, k].argmax())
            best[i], sure[i] = langs[j], float(p[j, k])
    return best, sure


def identify(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """All columns of docs and lang_pred, score. Only the text is looked at."""
    spark = bounded(docs).sparkSession
    held = spark.sparkContext.broadcast((langs, model))
    taken = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = taken.index("text")
    schema = docs.select(*taken).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, sure = score(b.column(at).to_pylist(), *held.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(sure, pa.float64())], names=[*taken, "lang_pred", "score"])

    return docs.select(*taken).mapInArrow(run, schema)


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per row of docs (doc_id, text, lang).

    Learned from documents whose crc32(doc_id as text) mod 5 is not 0 and whose lang is not null; ids that are null are held
    out. lang_pred is `und`, with score 0, if the text is null or has no letter, or nothing could be learned. Repeated
    rows are each predicted; other columns are ignored; an empty table gives no rows; texts are read whole.
    """
    fold = crc_mod(F.col("doc_id"), 5)
    langs, model = train(docs.filter(fold != 0), sample)
    return identify(docs.select("doc_id", (fold == 0).alias("held_out"), "text"), langs, model).select("doc_id", "held_out", "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
