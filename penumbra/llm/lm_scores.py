"""Language-model scores by deleted interpolation (operator 8).

P(w | c) = weight * n(c, w) / n(c) + (1 - weight) * P(w), and P(w) mixes n(w) / N with the uniform share of the known words and one
unknown. The weights belong to buckets of the context's frequency and are learned by expectation-maximisation: the counts of the
held-out fold are predicted from the counts with that fold deleted. All words and all bigrams of the training texts are counted.

So log P(w | c) = log P(w) + log(1 - weight + weight * ratio), where ratio = n(c, w) / n(c) / P(w). Counts of the most frequent words, of
a fixed number, are broadcast, and bigrams of the CLASSES most frequent ones are counted in a dense table. All other positions of
all texts go to buckets, once, as blobs: a position with a rarer next word to the bucket of that word, else with a rarer context
to the bucket of the context, else to that of the bigram. There n(c, w) and the count of the rarer word are counts of what has come. Only
where both words are rare is n(c) joined from the table of words. No bigram outside the dense table has more than a share of
1 / CLASSES of all positions, so no bucket gets a large part of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from penumbra.operators.graph import stored

from .common import bounded, crc_mod, parts, table

#: Words whose bigrams are in the dense table, and words whose counts are broadcast at most: fixed sizes, whatever the corpus.
CLASSES, BROADCAST_WORDS = 2046, 1 << 18
#: Different words that a task holds before it passes their counts on.
HELD_WORDS = 400_000
#: Tokens of the texts that a task packs at once, and training tokens for each bucket.
CHUNK_TOKENS, BUCKET_TOKENS = 1_500_000, 1_500_000
RARE, END = 0, 1
ROUNDS = 30
#: Steps of a doubling in which ratios of two estimates are told apart when weights are learned.
FINE, UNSEEN = 16, -(1 << 20)
#: Kinds of rows of scored positions.
SCORES, CELL, TEXT, BOTH_RARE = 0, 1, 2, 3
#: Folds of a text: deleted while weights are learned, other training texts, and texts that take no part in learning.
DELETED, TRAIN, HELD_OUT = 0, 1, 2
FIELDS = {"kind": pa.int8(), "uid": pa.int64(), "idx": pa.int64(), "c": pa.int64(), "n": pa.int64(), "d": pa.int64(), "nw": pa.int64(), "dw": pa.int64(), "fold": pa.int8(), "body": pa.binary()}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, deleted) over docs (text, deleted), deleted being the counts where that is true; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        gone: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array([gone[w] for w in counts], pa.int64())], names=["word", "n", "deleted"])

        for b in batches:
            for t, d in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = [*words_of(t.as_py()), b""]
                counts.update(own)
                if d:
                    gone.update(own)
                if len(counts) > HELD_WORDS:
                    yield out()
                    counts.clear()
                    gone.clear()
        yield out()

    return docs.select("text", "deleted").mapInArrow(run, "word binary, n long, deleted long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("deleted").alias("deleted"))


def frequent(counts: DataFrame, most: int) -> tuple[int, list[bytes], np.ndarray, np.ndarray]:
    """The least count t that at most `most` words reach, and those words (without the end) by falling count, their counts and deleted counts."""
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n") * 8) / 8).cast("long"))
    sizes = sorted(((r[0], r[1]) for r in counts.filter("word <> X''").groupBy(step.alias("s")).count().collect()), reverse=True)  # some hundred rows
    least, total = None, 0
    for s, n in sizes:
        total += n
        if total > most:
            break
        least = s
    if least is None:
        return 1 << 62, [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.filter((F.col("n") >= least) & F.expr("word <> X''")).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return least, got.column("word").to_pylist(), *(got.column(k).to_numpy().astype(np.int64) for k in ("n", "deleted"))


def class_pairs(docs: DataFrame, classes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of classes in docs (text, deleted), as context * size + next, with their counts and their counts where deleted is true."""
    size = len(classes) + 2
    held = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, sums = held.value.get, np.zeros((2, size * size), np.int64)
        for b in batches:
            for fold in (False, True):
                ids: list[int] = []
                flag = b.column(1).to_pylist()
                for i, t in enumerate(b.column(0)):
                    if flag[i] is fold:
                        ids.append(END)
                        ids += [get(w, RARE) for w in words_of(t.as_py())]
                    if len(ids) > 4_000_000 or i + 1 == len(flag) and ids:
                        a = np.array([*ids, END], np.int64)
                        sums[int(fold)] += np.bincount(a[:-1] * size + a[1:], minlength=size * size)
                        ids = []
        i = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(sums[:, i].sum(0)), pa.array(sums[1, i])], names=["pair", "n", "deleted"])

    # at most size * size rows reach the driver
    got = docs.select("text", "deleted").mapInArrow(run, "pair long, n long, deleted long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("deleted").alias("deleted")).toArrow()
    return tuple(got.column(k).to_numpy().astype(np.int64) for k in range(3))


class Codes(dict):
    """The rank of a frequent word; for any other its key, a negative number of 63 bits of its XXH64."""

    def __missing__(self, word: bytes) -> int:
        return xxh64_intdigest(word, 42) % (1 << 63) - (1 << 63)


KEY = "xxhash64(word) | (-9223372036854775807L - 1L)"


def buckets(context_counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(context_counts + 1)).astype(np.int64)


def word_weights(bucket: np.ndarray, ratio: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Weight of the higher order in each of 64 buckets; ratio: its estimate over that of the lower one for what was seen so many times.

    A context that was never seen (bucket 0) has no higher order.
    """
    lam = np.full(64, 0.5)
    for _ in range(ROUNDS):
        part = lam[bucket] * ratio
        part = part / (part + 1 - lam[bucket])
        # one pseudo-observation of each order keeps either possible
        lam = (np.bincount(bucket, part * seen, 64) + 1) / (np.bincount(bucket, seen, 64) + 2)
    lam[0] = 0
    return lam


class Unigrams:
    """P(w) by the count of w: mix is the weight of n / total, the rest is shared by the known words and one unknown."""

    def __init__(self, mix: float, total: int, kinds: int):
        self.slope, self.floor = mix / max(total, 1), (1 - mix) / (kinds + 1)

    def p(self, n):
        """n: numbers, or a column."""
        return n * self.slope + self.floor


def planes(a: np.ndarray) -> bytes:
    """The bytes of the numbers by their significance, so that those that are always zero compress to nothing."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def pack(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(planes(np.ascontiguousarray(a)) for a in arrays), codec="zstd", asbytes=True)


def unpack(body: bytes, *shapes: tuple[int, type]) -> list[np.ndarray]:
    """Arrays of these lengths and types, as they were packed."""
    raw = pa.decompress(body, sum(n * np.dtype(t).itemsize for n, t in shapes), codec="zstd", asbytes=True)
    out, at = [], 0
    for n, t in shapes:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(n))
        at += n * size
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of unsigned numbers, the first from zero; np.cumsum undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))


def batch(kind: int, rows: int, /, **columns) -> pa.RecordBatch:
    given = {"kind": np.full(rows, kind, np.int8), **columns}
    return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(rows, t) for k, t in FIELDS.items()], names=list(FIELDS))


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts rows by the keys, and where each run of equal rows begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], 0)
    return order, np.flatnonzero(new)


def word_pairs(texts: list, codes: Codes, end: int, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts at once: index of the text, context and next word of each bigram but those of the dense table.

    A word is its rank among the broadcast words, `end` for the end, else its negative key; ranks under `own` are in the dense table.
    """
    ids, of = [end], []
    for i, t in enumerate(texts):
        words = words_of(t)
        ids += map(codes.__getitem__, words)
        ids.append(end)
        of += repeat(i, len(words) + 1)
    a, of = np.array(ids, np.int64), np.array(of, np.int64)
    c, w = a[:-1], a[1:]
    classed = ((a >= 0) & (a < own)) | (a == end)
    keep = ~(classed[:-1] & classed[1:])
    return of[keep], c[keep], w[keep]


def packed_positions(docs: DataFrame, held, own: int, n_buckets: int) -> DataFrame:
    """(bucket, uid, m, common, body): positions of docs (doc_id, hash, fold, text); uid is a chunk of texts, and m = -1 marks its list of texts.

    A body holds, sorted by x: x (the bigram of two broadcast words, which are `common` and come first, or the key of a rarer word), the
    other word for those of rarer words, and the text's index in the chunk, its fold and whether x is the next word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        codes, end = Codes((w, i) for i, w in enumerate(words)), len(words)
        uid, size, texts, ids = TaskContext.get().partitionId() << 32, 0, [], []

        def out() -> pa.RecordBatch:
            of, c, w = word_pairs(texts, codes, end, own)
            rare_next, rare_before = w < 0, (w >= 0) & (c < 0)
            x = np.where(rare_next, w, np.where(rare_before, c, (c << 20) | np.maximum(w, 0))).view(np.uint64)
            other = np.where(rare_next, c, w)
            fold = np.array([f for _, _, f in ids], np.uint32)
            ref = (of.astype(np.uint32) << np.uint32(3)) | (fold[of] << np.uint32(1)) | rare_next.astype(np.uint32)
            to = (((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)
            order = np.lexsort((x, to))
            x, other, ref, to = x[order], other[order], ref[order], to[order]
            at = np.flatnonzero(np.diff(to, prepend=-1))
            rows = []
            for a, b in zip(at.tolist(), np.append(at, len(to))[1:].tolist(), strict=True):
                common = int(np.searchsorted(x[a:b], np.uint64(1 << 63)))
                rows.append((int(to[a]), uid, b - a, common, pack(steps(x[a:b]), other[a + common : b], ref[a:b])))
            known = np.array([i is not None for i, _, _ in ids], np.uint8)
            rows.append((uid % n_buckets, uid, -1, len(ids), pack(np.array([i or 0 for i, _, _ in ids], np.int64), known, np.array([h for _, h, _ in ids], np.int64))))
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(k, t) for k, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "uid", "m", "common", "body"])

        for b in batches:
            for doc_id, h, f, text in zip(*(k.to_pylist() for k in b.columns), strict=True):
                texts.append(text)
                ids.append((doc_id, h, f))
                size += 1 + len(text or "") // 6
                if size > CHUNK_TOKENS:
                    yield out()
                    uid, size, texts, ids = uid + 1, 0, [], []
        if texts:
            yield out()

    return docs.select("doc_id", "hash", "fold", "text").mapInArrow(run, "bucket int, uid long, m int, common int, body binary")


def scored_positions(packed: DataFrame, held, n_buckets: int) -> DataFrame:
    """FIELDS: for each chunk of each bucket SCORES (a body); CELL, counts of (context bucket idx, step c of a ratio) in the deleted fold; TEXT; BOTH_RARE.

    held: counts of the broadcast words, the end last, and of those in the deleted fold, Unigrams of all training texts and of those left by the deletion.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_n, known_d, full, rest = held.value
        cells: Counter = Counter()

        def count_cells(context: np.ndarray, ratio: np.ndarray) -> None:
            step = np.where(ratio > 0, np.rint(np.log2(np.where(ratio > 0, ratio, 1)) * FINE), UNSEEN).astype(np.int64)
            b = buckets(context)
            order, at = runs(b, step)
            for k, n in zip(zip(b[order][at].tolist(), step[order][at].tolist(), strict=True), np.diff(np.append(at, len(order))).tolist(), strict=True):
                cells[k] += n

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            uids = [r[0] for r in rows]
            got = [unpack(body, (m, np.uint64), (m - common, np.int64), (m, np.uint32)) for _, m, common, body in rows]
            x = np.concatenate([np.cumsum(g[0]) for g in got])
            other = np.concatenate([np.concatenate([np.zeros(r[2], np.int64), g[1]]) for r, g in zip(rows, got, strict=True)])
            ref = np.concatenate([g[2] for g in got])
            chunk = np.repeat(np.arange(len(rows)), [r[1] for r in rows])
            is_next, fold, idx = (ref & 1) == 1, (ref >> 1) & 3, (ref >> 3).astype(np.int64)
            train, gone = fold != HELD_OUT, fold == DELETED
            order, at = runs(x, other, is_next)
            group = np.empty(len(x), np.int64)
            group[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(x))))
            n, d = (np.bincount(group, flag, len(at)).astype(np.int64)[group] for flag in (train, gone))
            rare = x >= np.uint64(1 << 63)
            c, w = (x >> np.uint64(20)).astype(np.int64), (x & np.uint64((1 << 20) - 1)).astype(np.int64)
            look = lambda kind, code: kind[np.where(rare, 0, code)]
            cn, cd, wn, wd = look(known_n, c), look(known_d, c), look(known_n, w), look(known_d, w)
            # every occurrence of a rarer word has come as a next word
            ours, at_ours = np.unique(x[rare], return_inverse=True)
            n_ours, d_ours = (np.bincount(at_ours, (flag & is_next)[rare], len(ours)).astype(np.int64)[at_ours] for flag in (train, gone))
            there, after = np.maximum(other[rare], 0), is_next[rare]
            wn[rare], wd[rare] = np.where(after, n_ours, known_n[there]), np.where(after, d_ours, known_d[there])
            cn[rare], cd[rare] = np.where(after, known_n[there], n_ours), np.where(after, known_d[there], d_ours)
            pending = is_next & (other < 0)
            ratio = np.where(cn > 0, n / np.maximum(cn, 1) / full.p(wn), 0)
            learn = gone & ~pending
            left = (cn - cd)[learn]
            count_cells(left, np.where(left > 0, (n - d)[learn] / np.maximum(left, 1) / rest.p((wn - wd)[learn]), 0))
            if pending.any():
                k = np.flatnonzero(pending)
                yield batch(BOTH_RARE, len(k), uid=np.array(uids, np.int64)[chunk[k]], idx=idx[k], c=other[k], n=n[k], d=d[k], nw=wn[k], dw=wd[k], fold=fold[k].astype(np.int8))
            ends = np.cumsum([r[1] for r in rows])
            bodies, sizes = [], []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                i, k = a + np.flatnonzero(~pending[a:b]), a + np.flatnonzero(is_next[a:b])
                i, k = i[np.argsort(idx[i], kind="stable")], k[np.argsort(idx[k], kind="stable")]
                bodies.append(pack(steps(idx[i].astype(np.uint32)), buckets(cn[i]).astype(np.uint8), ratio[i].astype(np.float32), steps(idx[k].astype(np.uint32)), wn[k]))
                sizes.append((len(i), len(k)))
            yield batch(SCORES, len(rows), uid=uids, n=[s[0] for s in sizes], d=[s[1] for s in sizes], body=bodies)

        bucket, rows = None, []
        for b in batches:
            for to, uid, m, common, body in zip(*(k.to_pylist() for k in b.columns), strict=True):
                if m < 0:
                    ids, known, h = unpack(body, (common, np.int64), (common, np.uint8), (common, np.int64))
                    yield batch(TEXT, common, uid=np.full(common, uid), idx=np.arange(common), c=pa.array(ids, mask=known == 0), n=h)
                    continue
                if to != bucket and rows:
                    yield from out(rows)
                    rows = []
                bucket = to
                rows.append((uid, m, common, body))
        if rows:
            yield from out(rows)
        if cells:
            keys = list(cells)
            yield batch(CELL, len(keys), idx=[k[0] for k in keys], c=[k[1] for k in keys], n=list(cells.values()))

    fields = ", ".join(f"{k} {t}" for k, t in zip(FIELDS, ("byte", *["long"] * 7, "byte", "binary"), strict=True))
    by_bucket = packed.repartition(max(parts(packed.sparkSession), n_buckets // 16), "bucket").sortWithinPartitions("bucket")
    return by_bucket.mapInArrow(run, fields)


def text_sums(scores: DataFrame, held) -> DataFrame:
    """(uid, idx, known, base, model) of each body of SCORES; held: weights by bucket, Unigrams of all training texts, N + V + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lam, full, whole = held.value
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        for b in batches:
            for uid, m, k, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                idx, bucket, ratio, at, n = unpack(body, (m, np.uint32), (m, np.uint8), (m, np.float32), (k, np.uint32), (k, np.int64))
                idx, at = np.cumsum(idx).astype(np.int64), np.cumsum(at).astype(np.int64)
                weight = lam[bucket]
                size = 1 + max(int(idx[-1]) if m else 0, int(at[-1]) if k else 0)
                model = np.bincount(idx, np.log10(1 - weight + weight * ratio.astype(float)), size) + np.bincount(at, np.log10(full.p(n)), size)
                base, known = np.bincount(at, np.log10((n + 1) / whole), size), np.bincount(at, n > 0, size).astype(np.int64)
                here = np.flatnonzero(np.bincount(idx, minlength=size) + np.bincount(at, minlength=size))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((np.full(len(here), uid, np.int64), here, known[here], base[here], model[here]), types, strict=True)], names=["uid", "idx", "known", "base", "model"])

    return scores.select("uid", "n", "d", "body").mapInArrow(run, "uid long, idx long, known long, base double, model double")


def frequent_sums(docs: DataFrame, held) -> DataFrame:
    """doc_id, hash, held_out, n_tokens, known, base, model of each text, by its broadcast words and the dense table alone.

    held: broadcast words, their counts (the end last), number of those in the dense table, that table's logs (contexts and next words by rank, the end last), Unigrams, N + V + 1.
    """
    names = ["doc_id", "hash", "held_out", "n_tokens", "known", "base", "model"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, own, logs, full, whole = held.value
        get, end, missing = {w: i for i, w in enumerate(words)}.get, len(words), len(words) + 1
        base, model, known = (np.append(x, 0) for x in (np.log10((counts + 1) / whole), np.log10(full.p(counts)), counts > 0))
        classes = np.full(len(words) + 2, -1)
        classes[:own], classes[end] = np.arange(own), own
        for b in batches:
            sums = []
            for text in b.column(3).to_pylist():
                tokens = words_of(text)
                ids = np.array([end, *map(get, tokens, repeat(missing)), end])
                c = classes[ids]
                both = (c[:-1] >= 0) & (c[1:] >= 0)
                w = ids[1:]
                sums.append((len(tokens) + 1, int(known[w].sum()), float(base[w].sum()), float(model[w].sum()) + float(logs[c[:-1][both], c[1:][both]].sum(dtype=np.float64))))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([s[k] for s in sums], t) for k, t in enumerate(types))], names=names)

    return docs.select("doc_id", "hash", "held_out", "text").mapInArrow(run, "doc_id long, hash long, held_out boolean, n_tokens long, known long, base double, model double")


def lm_scores(docs: DataFrame, classes: int = CLASSES, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of docs (doc_id, text).

    Learned from documents whose crc32(doc_id as text) mod 7 is not 2 (null ids are among them); those with 0 are the fold that is
    deleted to learn the mixture. A null or empty text has the one token `end`. Rows equal in id and text score alike. Without training
    rows N and V are 0. Other columns are ignored; an empty table gives no rows; texts are read whole. docs is read several
    times and should be a table, or else give the same rows each time.
    """
    sc = bounded(docs).sparkSession.sparkContext
    fold = crc_mod(F.col("doc_id"), 7)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), (fold == 2).alias("held_out"), F.when(fold == 0, DELETED).when(fold == 2, HELD_OUT).otherwise(TRAIN).alias("fold"))
    learn = rows.filter("not held_out").select("text", (F.col("fold") == DELETED).alias("deleted"))
    counts = stored(word_counts(learn))
    at_end = lambda k: F.coalesce(F.sum(F.when(F.expr("word = X''"), F.col(k))), F.lit(0))
    total, gone, kinds, ends, ends_gone = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("deleted"), F.lit(0)), F.count("*"), at_end("n"), at_end("deleted")).first()
    whole = float(total + kinds + 1)
    # the lower order: counts in the deleted fold by the ratio of what is left to the uniform share, a fixed number of steps
    left = F.col("n") - F.col("deleted")
    step = F.when(left > 0, F.rint(F.log2(left * ((kinds + 1) / max(total - gone, 1))) * FINE)).otherwise(UNSEEN).cast("long")
    cells = counts.filter("deleted > 0").groupBy(step.alias("step")).agg(F.sum("deleted").alias("seen")).toArrow()
    unstep = lambda s: np.where(s > UNSEEN, 2.0 ** (np.maximum(s, -1000 * FINE) / FINE), 0.0)
    numbers = lambda t, k: t.column(k).to_numpy().astype(np.int64)
    mix = float(word_weights(np.ones(cells.num_rows, np.int64), unstep(numbers(cells, "step")), numbers(cells, "seen").astype(float))[1]) if total else 0.0
    full, rest = Unigrams(mix, total, kinds), Unigrams(mix, total - gone, kinds)

    least, words, word_n, word_d = frequent(counts, broadcast_words)
    own = min(classes, len(words))
    pair, pair_n, pair_d = class_pairs(learn, {w: i + 2 for i, w in enumerate(words[:own])})
    size = own + 2
    known_n, known_d = np.append(word_n, ends), np.append(word_d, ends_gone)
    u, v = pair // size, pair % size
    both = (u != RARE) & (v != RARE)
    rank = lambda k: np.where(k == END, own, k - 2)
    u, v, pn, pd = rank(u[both]), rank(v[both]), pair_n[both], pair_d[both]
    code = np.append(np.arange(own), len(words))  # in known_n
    cn, cd, wn, wd = known_n[code][u], known_d[code][u], known_n[code][v], known_d[code][v]
    before = cn - cd
    class_ratio = (pn - pd) / np.maximum(before, 1) / rest.p(wn - wd)

    n_buckets = max(4 * parts(docs.sparkSession), total // BUCKET_TOKENS)
    held_words = sc.broadcast(words)
    found = stored(scored_positions(packed_positions(rows, held_words, own, n_buckets), sc.broadcast((known_n, known_d, full, rest)), n_buckets))
    rarer = counts.filter((F.col("n") < least) & F.expr("word <> X''")).select(F.expr(KEY).alias("c"), F.col("n").alias("cn"), F.col("deleted").alias("cd"))
    zero = lambda k: F.coalesce(k, F.lit(0))
    both_rare = stored(found.filter(F.col("kind") == BOTH_RARE).select("uid", "idx", "c", "n", "d", "nw", "dw", "fold").join(rarer, "c", "left").withColumn("cn", zero("cn")).withColumn("cd", zero("cd")))
    spread = lambda n: F.length(F.bin(n + 1))  # noqa: E731  one more than the bucket
    after = (F.col("n") - F.col("d")) / (F.col("cn") - F.col("cd")) / rest.p(F.col("nw") - F.col("dw"))
    rare_step = F.when(F.expr("n > d and cn > cd"), F.rint(F.log2(after) * FINE)).otherwise(UNSEEN).cast("long")
    rare_cells = both_rare.filter(F.col("fold") == DELETED).groupBy((spread(F.col("cn") - F.col("cd")) - 1).cast("long").alias("idx"), rare_step.alias("c")).agg(F.count("*").alias("n"))
    # buckets and steps of a ratio, a fixed number whatever the corpus
    got = found.filter(F.col("kind") == CELL).select("idx", "c", "n").unionByName(rare_cells).groupBy("idx", "c").agg(F.sum("n").alias("n")).toArrow()
    lam = word_weights(np.concatenate([numbers(got, "idx"), buckets(before)]), np.concatenate([unstep(numbers(got, "c")), class_ratio]), np.concatenate([numbers(got, "n"), pd]).astype(float))

    logs = np.repeat(np.log10(1 - lam[buckets(known_n[code])]).astype(np.float32)[:, None], own + 1, 1)
    weight = lam[buckets(cn)]
    logs[u, v] = np.log10(1 - weight + weight * (pn / np.maximum(cn, 1) / full.p(wn)))
    texts = frequent_sums(rows, sc.broadcast((words, known_n, own, logs, full, whole)))
    sums = text_sums(found.filter(F.col("kind") == SCORES), sc.broadcast((lam, full, whole)))
    share = F.element_at(F.array(*[F.lit(float(x)) for x in lam]), spread(F.col("cn")))
    ratio = F.when(F.col("cn") > 0, F.col("n") / F.col("cn") / full.p(F.col("nw"))).otherwise(0.0)
    more = both_rare.select("uid", "idx", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.log10(1 - share + share * ratio).alias("model"))
    in_chunks = sums.unionByName(more).groupBy("uid", "idx").agg(*(F.sum(k).alias(k) for k in ("known", "base", "model")))
    null = lambda t: F.lit(None).cast(t)
    of = found.filter(F.col("kind") == TEXT).select("uid", "idx", F.col("c").alias("doc_id"), F.col("n").alias("hash"))
    rest_sums = in_chunks.join(of, ["uid", "idx"]).select("doc_id", "hash", null("boolean").alias("held_out"), null("long").alias("n_tokens"), "known", "base", "model")
    grouped = texts.unionByName(rest_sums).groupBy("doc_id", "hash").agg(
        F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.count("n_tokens").alias("rows"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("model").alias("model"))
    return grouped.select(
        "doc_id", "held_out", "n_tokens", F.expr("known div rows").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"), (F.col("model") / F.col("rows")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"),
    ).drop("copy")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
