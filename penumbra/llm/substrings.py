"""Substring dedup (operator 5): paragraph MinHash banding.

A text is cut into paragraphs at line and sentence ends and at commas, by what stands just before each of them, so that a
passage copied into the middle of another text is cut at the same places there. Paragraphs are their sets of five-word
shingles. Those that share a band of their MinHash signature collide; colliding paragraphs are joined with their
shingles, verified by exact Jaccard similarity and clustered by connected components. A cluster stays in the document of the
least id; a run of its paragraphs in later documents is removed where it has enough words.

Each text is read once for the bands, the shingles, the clusters' documents and the places, by one plan at any size: bands and places are
narrow rows, and shingles travel once for each paragraph that is long enough to be similar to another. A bucket of more than CHUNK
paragraphs is thinned by a second band, and what is still larger is dealt out in pairs of chunks, so that no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators.graph import connected_components as components
from penumbra.operators.graph import stored

from .common import bounded, cut, parts, table

SHINGLE, SIMILARITY, RUN_WORDS = 5, 0.8, 20
#: A comma cuts where so many words have come since the last comma, sentence end or line end.
LEAST_CLAUSE = 5
#: Where so many words have come without any of these, every word whose hash is a multiple of EACH cuts.
LEAST_BARE, EACH = 24, 8
#: Bands of one row each: a pair of similarity s is found with 1 - (1 - s) ** BANDS, 0.9984 at 0.8. Unrelated paragraphs share no shingle of five words.
BANDS = 4
#: Paragraphs of a bucket that a task verifies with each other, or with as many of another chunk.
CHUNK = 512
#: Rows of removals, or of large buckets, up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Paragraphs that a task remembers, so as to pass those that keep coming on once only.
REMEMBERED = 1 << 18
M1, M2, P5 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x100000001B3)
SEEDS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x94D049BB133111EB], np.uint64)


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


BLANK, STOP, PAUSE, CLOSING = _set(b"\t\n\x0b\x0c\r "), _set(b".!?"), _set(b",;:"), _set(b"\")")
BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) ^ np.uint64(0x2545F4914F6CDD1D)
#: Bytes of text that are analysed at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1_000_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * M2
    return h ^ (h >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, n - 1), base, np.uint64), dtype=np.uint64)])


def _to_end(sizes: np.ndarray) -> np.ndarray:
    """Of each member of consecutive groups of these sizes, how many follow in its group."""
    return np.repeat(np.cumsum(sizes), sizes) - np.arange(int(sizes.sum())) - 1


class Chunk:
    """Words and paragraphs of some texts: of each paragraph the text (of), the words (start, stop) and a hash (whole).

    whole depends on the set of shingles alone; a paragraph shorter than a shingle is one itself. The different shingles of
    paragraph i are grams[at[i]:at[i + 1]].
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
        inked = ~BLANK[data]
        edge = np.diff(np.concatenate([[False], inked]).astype(np.int8))
        first = np.flatnonzero(edge == 1)
        last = np.flatnonzero(edge == -1) - 1
        self.n = n = len(first)
        self.of = np.zeros(0, np.int64)
        self.start = self.stop = self.size = np.zeros(0, np.int64)
        self.whole = self.grams = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)
        if not n:
            return
        sizes = last - first + 1
        spread = _to_end(sizes)
        heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        words = _mixed(np.add.reduceat(BYTES[data[inked]] * _powers(P5, int(sizes.max()))[spread], heads))
        text = np.searchsorted(offsets, first, side="right") - 1
        line = np.cumsum(data == 10)[first]
        end, before = data[last], data[np.maximum(last - 1, 0)]
        stop = STOP[end] | (CLOSING[end] & (before == 46) & (sizes > 1))
        stop[:-1] |= line[:-1] != line[1:]
        stop[-1] = True
        mark = stop | PAUSE[end]
        at = np.arange(1, n + 1)
        since = at - np.concatenate([[0], np.maximum.accumulate(np.where(mark, at, 0))[:-1]])  # words since the last mark
        self.stop = at[stop | (mark & (since >= LEAST_CLAUSE)) | ((since > LEAST_BARE) & (words % np.uint64(EACH) == 0))]
        self.start = np.concatenate([[0], self.stop[:-1]])
        self.size = self.stop - self.start
        self.of = text[self.start]
        grams = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            grams = (grams + words[k : k + len(grams)]) * M1
            grams ^= grams >> np.uint64(32)
        many = np.maximum(self.size - SHINGLE + 1, 0)
        paragraph = np.repeat(np.arange(len(many)), many)
        grams = grams[np.arange(len(paragraph)) + np.repeat(self.start - np.cumsum(many) + many, many)]
        order = np.lexsort((grams, paragraph))
        grams, paragraph = grams[order], paragraph[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (paragraph[1:] != paragraph[:-1])
        grams, paragraph = grams[new], paragraph[new]
        short = np.flatnonzero(self.size < SHINGLE)
        self.whole = whole = np.zeros(len(many), np.uint64)
        self.at = np.searchsorted(paragraph, np.arange(len(many) + 1))
        self.grams = grams
        if len(grams):
            long = np.flatnonzero(many)
            whole[long] = _mixed(np.add.reduceat(_mixed(grams ^ P5), self.at[long]))
        if len(short):
            k = self.size[short]
            inside = np.arange(int(k.sum())) + np.repeat(self.start[short] - np.cumsum(k) + k, k)
            whole[short] = _mixed(np.add.reduceat(words[inside] * _powers(P5, SHINGLE)[_to_end(k)], np.cumsum(k) - k) + k.astype(np.uint64) * M1)

    def comparable(self, similarity: float) -> np.ndarray:
        """Paragraphs with so many different shingles that another set can be similar enough."""
        return np.flatnonzero(np.diff(self.at) >= max(1, ceil(similarity / max(1 - similarity, 1e-9) - 1e-9)))

    def keys(self, bands: int, of: np.ndarray) -> np.ndarray:
        """Band keys (paragraphs of these numbers, bands): the least seeded hash of a shingle."""
        return band_minima(self.grams, self.at, of, SEEDS[:bands])

    def shingles(self, of: np.ndarray) -> pa.Array:
        """The shingles of these paragraphs, as bytes."""
        sizes = (self.at[of + 1] - self.at[of]).astype(np.int64)
        inside = np.arange(int(sizes.sum())) + np.repeat(self.at[of] - np.cumsum(sizes) + sizes, sizes)
        ends = np.concatenate([[0], np.cumsum(sizes) * 8]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(self.grams[inside].tobytes())])


def band_minima(grams: np.ndarray, at: np.ndarray, of: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(of, seeds): the least of the seeded hashes of grams[at[i]:at[i + 1]], none of which is empty, for each i in of."""
    out = np.zeros((len(of), len(seeds)), np.uint64)
    if len(of):
        bounds = np.stack([at[of], at[of + 1]], 1).reshape(-1)
        padded = np.append(grams, np.uint64(0))  # as the last bound may be the end
        for k, s in enumerate(seeds):
            out[:, k] = np.minimum.reduceat(_mixed(padded ^ s), bounds)[::2]
    return (_mixed(out) ^ seeds[None, :]).view(np.int64)


class Recent:
    """A fixed number of the hashes that came last; new() tells which of some are not among them."""

    def __init__(self):
        self.held = np.zeros(REMEMBERED, np.uint64)

    def new(self, hashes: np.ndarray) -> np.ndarray:
        _, first = np.unique(hashes, return_index=True)
        slot = (hashes[first] % np.uint64(REMEMBERED)).astype(np.int64)
        fresh = self.held[slot] != hashes[first]
        self.held[slot[fresh]] = hashes[first][fresh]
        return first[fresh]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, Chunk]]:
    """Chunks of consecutive texts, each with the number of its first."""
    part, size, begin = [], 0, 0
    for i, t in enumerate(texts):
        part.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size > CHUNK_BYTES or i + 1 == len(texts):
            yield begin, Chunk(part)
            part, size, begin = [], 0, i + 1


def cuts(text: str) -> list[int]:
    """The index after the last word of each paragraph of a text."""
    return Chunk([text.encode("utf-8", "surrogatepass")]).stop.tolist()


def _batches(rows: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c and isinstance(c[0], np.ndarray) else c, t) for c, t in zip(rows, types, strict=True)], names=names)


def band_keys(docs: DataFrame, similarity: float, bands: int) -> DataFrame:
    """(key, paragraph): each band of the paragraphs of docs (text) that can be similar to others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for b in batches:
            for _, c in chunks(b.column(0).to_pylist()):
                of = c.comparable(similarity)
                of = of[recent.new(c.whole[of])]
                yield _batches([[c.keys(bands, of).T.reshape(-1)], [np.tile(c.whole[of].view(np.int64), bands)]], ["key", "paragraph"], [pa.int64()] * 2)

    return docs.select("text").mapInArrow(run, "key long, paragraph long")


def shingle_rows(docs: DataFrame, similarity: float) -> DataFrame:
    """(paragraph, shingles): the paragraphs of docs (text) that can be similar to others; those that recur may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for b in batches:
            for _, c in chunks(b.column(0).to_pylist()):
                of = c.comparable(similarity)
                of = of[recent.new(c.whole[of])]
                yield pa.RecordBatch.from_arrays([pa.array(c.whole[of].view(np.int64)), c.shingles(of)], names=["paragraph", "shingles"])

    return docs.select("text").mapInArrow(run, "paragraph long, shingles binary")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, at, paragraph, words): each paragraph of docs with its place; hash is that of the text, as ids may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for begin, c in chunks(b.column(2).to_pylist()):
                at = np.arange(len(c.of)) - np.searchsorted(c.of, c.of)  # texts come in order
                yield _batches([[ids[begin + c.of]], [hashes[begin + c.of]], [at], [c.whole.view(np.int64)], [c.size]], ["doc_id", "hash", "at", "paragraph", "words"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, at int, paragraph long, words int")


def ranges(docs: DataFrame) -> DataFrame:
    """(paragraph, low, high): the least and the greatest doc_id of each paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for begin, c in chunks(b.column(1).to_pylist()):
                own = ids[begin + c.of]
                order = np.lexsort((own, c.whole))
                whole, own = c.whole[order], own[order]
                at = np.flatnonzero(np.append(True, whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, np.int64)
                yield _batches([[whole[at].view(np.int64)], [own[at]], [own[np.append(at, len(own))[1:] - 1]]], ["paragraph", "low", "high"], [pa.int64()] * 3)

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "paragraph long, low long, high long")
    return rows.groupBy("paragraph").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams (key, paragraph) sorted by both; leaves the different rows of keys that have more than one."""
    key, paragraph, done = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last row, and whether it has been passed on
    for b in batches:
        k, p = (np.concatenate([held, b.column(i).to_numpy(zero_copy_only=False)]) for i, held in enumerate((key, paragraph)))
        if not len(k):
            continue
        new = np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1]))
        k, p = k[new], p[new]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        sizes = np.diff(np.append(at, len(k)))
        several = sizes > 1
        out = np.repeat(several, sizes)
        out[0] &= not done
        done = bool(several[-1]) or (done and len(sizes) == 1)
        key, paragraph = k[-1:], p[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(p[out])], names=["key", "paragraph"])


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, large, paragraph, shingles) -> (key, paragraph, shingles): a row of a large bucket goes to one for each of a second set of bands."""
    for b in batches:
        b = pa.Table.from_batches([b]).combine_chunks()
        key, large = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        stay, split = np.flatnonzero(~large), np.flatnonzero(large)
        yield pa.RecordBatch.from_arrays([pa.array(key[stay]), *(b.column(k).take(pa.array(stay)).combine_chunks() for k in (2, 3))], names=["key", "paragraph", "shingles"])
        if len(split):
            sets = [np.frombuffer(x, np.uint64) for x in b.column(3).take(pa.array(split)).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            low = band_minima(np.concatenate(sets), at, np.arange(len(sets)), SEEDS[BANDS : 2 * BANDS])
            for k in range(BANDS):
                again = _mixed(low[:, k].view(np.uint64) ^ (key[split].view(np.uint64) * M1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(again), *(b.column(c).take(pa.array(split)).combine_chunks() for c in (2, 3))], names=["key", "paragraph", "shingles"])


def _similar(ids: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning pairs of the paragraphs that are at least so similar; counted over postings of shared shingles."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), sizes)
    _, gram = np.unique(flat, return_inverse=True)
    order = np.argsort(gram, kind="stable")
    members, starts = of[order], np.concatenate([[0], np.cumsum(np.bincount(gram))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i in range(len(ids)):
        shared = np.bincount(np.concatenate([members[starts[g] : starts[g + 1]] for g in gram[at[i] : at[i + 1]]]), minlength=len(ids))
        close = np.flatnonzero(shared >= similarity * (sizes[i] + sizes - shared) - 1e-9)
        for j in close[close > i]:
            if (a := find(i)) != (b := find(int(j))):
                root[b] = a
                out.append((ids[i], ids[int(j)]))
    return out


def verify(similarity: float):
    """Streams rows (bucket, paragraph, shingles) sorted by bucket; a bucket holds at most two chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids = sorted(held)
                if links := _similar(ids, [np.frombuffer(held[i], np.uint64) for i in ids], similarity):
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for key, paragraph, shingles in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != bucket:
                    yield from flush()
                    bucket, held = key, {}
                held[paragraph] = shingles
        yield from flush()

    return run


def _if_few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast where there are at most BROADCAST_ROWS of them, so that what they are joined to stays where it is."""
    held = cut(rows)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def similar_paragraphs(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """(a, b): spanning links between different paragraphs of docs that collide in a band and are at least so similar."""
    n = parts(docs.sparkSession)
    members = stored(band_keys(docs, similarity, bands).repartition(n, "key").sortWithinPartitions("key", "paragraph").mapInArrow(_shared, "key long, paragraph long"))
    large = members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK).select("key", F.lit(True).alias("large"))
    large = _if_few(large)
    wanted = members.select("paragraph").distinct()
    shingles = shingle_rows(docs, similarity).join(wanted, "paragraph", "left_semi").groupBy("paragraph").agg(F.first("shingles").alias("shingles"))
    named = members.join(large, "key", "left").select("key", F.coalesce("large", F.lit(False)).alias("large"), "paragraph")
    thin = stored(named.join(shingles, "paragraph").select("key", "large", "paragraph", "shingles").mapInArrow(_thinned, "key long, paragraph long, shingles binary"))
    sizes = _if_few(thin.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK))
    dealt = (
        thin.join(sizes, "key", "left").withColumn("chunks", F.ceil(F.coalesce("n", F.lit(1)) / CHUNK).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("paragraph"), F.col("chunks")).cast("int"))
        .select("key", "paragraph", "shingles", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "paragraph", "shingles")
    )
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(verify(similarity), "a long, b long")


def duplicate_runs(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, hash, at, words, root): paragraphs to remove: their cluster is in a document of a lesser id, and they are in a run of such of at least run_words words."""
    roots = cut(components(similar_paragraphs(bounded(docs), similarity, bands)))
    # paragraphs that are in more than one document or similar to others; what is in one alone goes here
    spans = ranges(docs).join(roots.withColumnRenamed("node", "paragraph"), "paragraph", "left").filter("low < high or root is not null")
    kinds = stored(spans.select("paragraph", F.coalesce("root", "paragraph").alias("root"), "low", "high"))
    # cut, so that both sides of the join are exchanged and a cluster of very many paragraphs can be split
    first = cut(kinds.groupBy("root").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first < last").select("root", "first"))
    marks = kinds.join(first, "root").filter("high > first").select("paragraph", "root", "first")
    # both sides are exchanged, so a paragraph of many occurrences can be split
    later = occurrences(docs).join(marks, "paragraph").filter("doc_id > first").select("doc_id", "hash", F.col("at").cast("long").alias("at"), F.col("words").cast("long").alias("words"), "root")
    own = later.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set(F.struct("at", "words", "root"))).alias("runs"))  # the paragraphs of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text_hash, marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                group: list[dict] = []
                for m in [*marks, {"at": 1 << 60}]:
                    if group and m["at"] != group[-1]["at"] + 1:
                        if sum(x["words"] for x in group) >= run_words:
                            for x in group:
                                for c, v in zip(out, (doc_id, text_hash, x["at"], x["words"], x["root"]), strict=True):
                                    c.append(v)
                        group = []
                    group.append(m)
            yield _batches(out, ["doc_id", "hash", "at", "words", "root"], [pa.int64()] * 5)

    return own.mapInArrow(run, "doc_id long, hash long, at long, words long, root long")


def without(text: str | None, gone: list[int] | None) -> str | None:
    """The text without the paragraphs of these numbers; the rest keeps its bytes, but for the white space round what goes."""
    if not text or not gone:
        return text
    ends = cuts(text)
    gone_words, start = set(), 0
    drop = set(gone)
    for i, e in enumerate(ends):
        if i in drop:
            gone_words.update(range(start, e))
        start = e
    lines, at = [], 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        own = line.split()
        stay = [w for i, w in enumerate(own, at) if i not in gone_words]
        at += len(own)
        if len(stay) == len(own):
            lines.append(line)
        elif stay:
            lines.append(b" ".join(stay))
    return b"\n".join(lines).decode("utf-8", "surrogatepass")


def substring_dedup(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, n_removed, words_removed, removed (paragraph numbers), clusters (of them), has_repeats; one row per row of docs.

    docs: doc_id, text. What repeats across documents goes from all but that of the least id; what a document repeats within
    itself stays. A null or empty text has no paragraph, a text of fewer than five words is compared as a whole. Rows with a null
    doc_id are kept as they are and take no part. Rows of the same doc_id are one document, whose texts keep what they share; each
    text is cut by its own paragraphs, and each row gives a row. Other columns are ignored; an empty table gives no rows.
    """
    gone = duplicate_runs(docs, similarity, bands, run_words).groupBy("doc_id", "hash").agg(
        F.count("*").alias("n"), F.sum("words").alias("w"), F.array_sort(F.collect_set("at")).alias("removed"), F.array_sort(F.collect_set("root")).alias("clusters"))
    none = F.array().cast("array<long>")
    return docs.select("doc_id", F.xxhash64("text").alias("hash")).join(gone, ["doc_id", "hash"], "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n_removed"), F.coalesce("w", F.lit(0)).alias("words_removed"),
        F.coalesce("removed", none).alias("removed"), F.coalesce("clusters", none).alias("clusters"), F.col("n").isNotNull().alias("has_repeats"),
    )


def remove_repeats(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with the repeats taken out of text (and n_chars set anew, if there); rows of which nothing is left go, others stay as in substring_dedup."""
    gone = cut(duplicate_runs(docs, similarity, bands, run_words).groupBy(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).agg(F.collect_set("at").alias("__gone")))
    side = F.broadcast if gone.count() <= BROADCAST_ROWS else (lambda d: d)
    joined = docs.join(side(gone), (docs.doc_id == F.col("__id")) & (F.xxhash64(docs.text) == F.col("__hash")), "left").select(*docs.columns, "__gone")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([without(t, g) for t, g in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(b.columns[:-1])] + [b.column(b.num_columns - 1).is_valid()], names=[*names, "__cut"])

    done = joined.mapInArrow(run, docs.select(*docs.columns).schema.add("__cut", "boolean"))
    done = done.filter("not __cut or length(trim(text)) > 0")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
