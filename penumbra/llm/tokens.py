"""Token counts by byte-pair merging (operator 3).

Each piece of text is a doubly linked list of symbols in arrays; a heap holds the adjacent pairs by merge rank and
position. The lowest pair is popped, merged when its two symbols are still the ones it was pushed with, and its two new
neighbours are pushed. The count is the number of first symbols less the merges; no identifiers are made.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, table

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Pieces whose counts a worker remembers, and their length at most; others are counted again, so memory stays bounded.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 64
#: Fixed: how a byte-level vocabulary cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def refuse_other_kinds(spec: dict) -> None:
    """Raises ValueError if a vocabulary file asks for what the counter does not do."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for k in ("normalizer", "truncation", "padding") if spec.get(k)]
    odd += ["model.type"] if model.get("type", "BPE") != "BPE" else []
    odd += ["pre_tokenizer"] if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) else []
    odd += [f"added token {t['content']!r}" for t in spec.get("added_tokens") or () if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if odd:
        raise ValueError(f"not a plain byte-level vocabulary: {', '.join(odd)}")


class Counter:
    """Counts tokens with the merges of a byte-level vocabulary file (its JSON form)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_other_kinds(spec)
        names = byte_symbols()
        ids: dict[str, int] = {s: i for i, s in enumerate(names)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            new = ids.setdefault(left + right, len(ids))
            self.merges.setdefault((ids[left], ids[right]), (rank, new))
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces = regex.compile(PIECES).findall

        class Known(dict):
            def __missing__(known, piece: str) -> int:  # noqa: N805
                n = self.piece(piece.encode("utf-8", "surrogatepass"))
                if len(known) < REMEMBERED and len(piece) <= REMEMBERED_CHARS:
                    known[piece] = n
                return n

        self.known = Known()

    def piece(self, data: bytes) -> int:
        n = len(data)
        if n < 2:
            return n
        merges, sym = self.merges, list(data)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if m := merges.get((sym[i], sym[i + 1])):
                heap.append((m[0], i, sym[i], sym[i + 1], m[1]))
        heapify(heap)
        count = n
        while heap:
            _, i, a, b, new = heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j] = new, -1
            k = right[i] = right[j]
            count -= 1
            if k >= 0:
                left[k] = i
                if m := merges.get((new, sym[k])):
                    heappush(heap, (m[0], i, new, sym[k], m[1]))
            h = left[i]
            if h >= 0 and (m := merges.get((sym[h], new))):
                heappush(heap, (m[0], h, sym[h], new, m[1]))
        return count

    def count(self, text: str) -> int:
        if self.cut is None or not any(s in text for s in self.special):
            return sum(map(self.known.__getitem__, self.pieces(text)))
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(sum(map(self.known.__getitem__, self.pieces(p))) for p in parts)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per row of docs (doc_id, text): bytes, tokens and whether the tokens exceed limit.

    path: a byte-level vocabulary file, which every executor can open; ValueError if it is of another kind. Special strings inside a text count as one token.
    A null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows are each counted; other
    columns are ignored; an empty table gives no rows. Texts of any length are counted whole.
    """

    with open(path, encoding="utf-8") as f:
        refuse_other_kinds(json.load(f))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return bounded(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
