"""Quality classifier (operator 10): histogram gradient-boosted trees over document statistics.

Statistics are computed beside the scan. The trees are fitted on the driver from a bounded sample of labelled documents,
binned once to histograms, and flattened to arrays of equal depth that batches walk in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, crc_mod, table

#: Labelled documents that the trees are fitted on, about: more are thinned by a hash of their id.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF, L2 = 80, 4, 64, 0.15, 10, 1.0
NOISY = re.compile(rb"(?:[#*$%&<>=~^]{2,}|!{2,})(?=[\s]|$)")
UPPER, DIGITS, MARKS, SYMBOLS = (bytes(range(65, 91)), b"0123456789", b".,;:!?'\"()-", b"#*$%&|<>{}[]=~^_\\/@")
ENDS = (b".", b"!", b"?", b'"', b":")
FEATURES = 20


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = len(lines)
    count = lambda chars: size - len(data.translate(None, chars))
    d, k, q = max(size, 1), max(n, 1), max(m, 1)
    unique = len(set(words))
    longest = max(map(len, words), default=0)
    letters = len(b"".join(words))
    high = size - len(data.decode("utf-8", "surrogatepass")) if not data.isascii() else 0
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 0
    return [
        n, size, letters / k, count(UPPER) / d, count(DIGITS) / d, count(MARKS) / d, count(SYMBOLS) / d, len(NOISY.findall(data)) / k,
        data.count(b" | ") / k, data.count(b"!!") / k, unique / k, 1 - len(set(lines)) / q, sum(1 for x in lines if x.rstrip().endswith(ENDS)) / q, n / q,
        m, longest, high / d, pairs / max(n - 1, 1), max(map(len, lines), default=0) / d, data.count(b"http") / k,
    ]


class Trees:
    """Boosted trees for one logistic score, in flat arrays: node i of a tree has the children 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Newton boosting of the log loss; splits from histograms of gradient and curvature. No rows: a score of 0.5 for all."""
    if not len(y):
        return Trees(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    out, inner = np.full(len(y), base), 2**DEPTH - 1
    features, levels, values = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-out))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-9)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            local = node - first
            best = np.zeros(width)
            where = np.full((width, 2), -1)
            for f, own in enumerate(binned):
                key = local * BINS + own
                G, H, C = (np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, np.ones(len(y))))
                tG, tH, tC = G[:, -1:], H[:, -1:], C[:, -1:]
                gain = G**2 / (H + L2) + (tG - G) ** 2 / (tH - H + L2) - tG**2 / (tH + L2)
                gain[(C < LEAST_LEAF) | (tC - C < LEAST_LEAF)] = 0
                gain[:, len(cuts[f]) :] = 0
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                won = top > best + 1e-9
                best[won], where[won] = top[won], np.stack([np.full(width, f), b], 1)[won]
            for k in range(width):
                if where[k, 0] >= 0:
                    feature[first + k], cut[first + k] = where[k, 0], cuts[where[k, 0]][where[k, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        G, H = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
        value = -RATE * G / (H + L2)
        out += value[leaf]
        features.append(feature), levels.append(cut), values.append(value)
    return Trees(base, np.array(features), np.array(levels), np.array(values))


def _stats_frame(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, FEATURES)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """docs: doc_id, text; labels: doc_id, quality. Rows of a null label are left out; an id with many labels or texts counts by each, equal rows once.

    sample: labels that are taken, about; and, where ids repeat, different texts, about.
    """
    labels = labels.select("doc_id", "quality").filter("quality is not null and doc_id is not null")
    n = labels.count()
    if n > sample:
        labels = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < int(1e6 * sample / n) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _stats_frame(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int64()), *(pa.array(c) for c in x.T)], names=["doc_id", "quality", *(f"f{i}" for i in range(FEATURES))])

    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("doc_id", "quality", "text")  # the sample is bounded
    if docs.select("doc_id").join(F.broadcast(labels), "doc_id").count() > 2 * sample:
        texts = rows.select("doc_id", "quality", F.xxhash64("text")).distinct().count()
        rows = rows.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_000)) < int(1e6 * sample / texts) + 1)
    got = rows.mapInArrow(run, "doc_id long, quality long, " + ", ".join(f"f{i} double" for i in range(FEATURES))).distinct().toArrow()
    got = got.sort_by([(c, "ascending") for c in got.column_names])  # so that reruns agree
    x = np.stack([got.column(2 + i).to_numpy() for i in range(FEATURES)], 1)
    return fit(x, got.column("quality").to_numpy().astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of docs (doc_id, text).

    Labels are learned only from ids whose crc32(doc_id as text) mod 5 is not 0. A null text is scored as an empty one; a
    null id is held out; repeated rows are each scored; other columns are ignored; an empty table gives no rows, and without
    labels every score is 0.5. Texts are read whole.
    """
    fold = crc_mod(F.col("doc_id"), 5)
    trees = train(bounded(docs), labels.filter(fold != 0), sample)
    held = docs.sparkSession.sparkContext.broadcast((trees.base, trees.feature, trees.cut, trees.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(*held.value)
        for b in batches:
            p = model.predict(_stats_frame(b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (fold == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
