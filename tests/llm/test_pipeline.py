"""Each stage of the pipeline against a brute-force version of its decision, on what its predecessor kept."""

import zlib
from collections import Counter

import pytest

from penumbra.llm import decontaminate, langid, simhash, substrings

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return {n: (a, b, c) for n, a, b, c in out}


def test_columns(stages):
    for name in list(stages)[:-1]:
        assert stages[name][2] == pipeline.COLUMNS


def test_language_stage_keeps_what_has_letters(stages):
    before, after, _ = stages["language_id"]
    kept = {r.doc_id for r in after}
    lettered = {r.doc_id for r in before if r.text and langid.LETTER.search(r.text)}
    assert kept <= lettered and len(kept) >= 0.98 * len(lettered)


def test_one_of_each_near_group_stays(stages):
    before, after, _ = stages["simhash_near_dedup"]
    fps = [(r.doc_id, simhash.fingerprint(r.text)) for r in before]
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(fps):
        for e, b in fps[:i]:
            if (a ^ b).bit_count() <= 4 and find(d) != find(e):
                x, y = sorted((find(d), find(e)))
                root[y] = x
    assert sorted(r.doc_id for r in after) == sorted({find(d) for d, _ in fps})


def test_no_long_run_of_paragraphs_is_left_twice(stages):
    before, after, _ = stages["substring_dedup"]
    seen: Counter = Counter()
    for r in after:
        c = substrings.Chunk([r.text.encode()])
        seen.update({h for h, n in zip(c.whole.tolist(), c.size.tolist()) if n >= substrings.RUN_WORDS})
    assert max(seen.values(), default=0) <= 1
    texts = {r.doc_id: r.text for r in before}
    assert all(set(r.text.split()) <= set(texts[r.doc_id].split()) for r in after)


def test_contaminated_documents_go(spark, sf_dir, stages):
    from llm.test_llm import brute_hits

    before, after, _ = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {d for d, _, _, _, bad in brute_hits([(r.doc_id, r.text) for r in before], items) if not bad}
    assert {r.doc_id for r in after} == clean
    assert decontaminate.K < 10


def test_mix_takes_its_targets(stages):
    before, after, _ = stages["mixing"]
    taken, goal = Counter(), {}
    for r in after:
        taken[r.source] += r.taken
        goal[r.source] = int(r.target)
        assert r.size == len((r.text or "").encode().split()) and r.taken == r.epochs * r.size + r.rest
    assert taken == goal


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    want = Counter(zlib.crc32(repr((r.doc_id, r.taken)).encode()) for r in stages["mixing"][1])
    assert Counter(zlib.crc32(repr((r.doc_id, r.taken)).encode()) for r in pipeline.run(spark, sf_dir).collect()) == want


def test_stages_take_odd_rows_and_empty_tables(spark, sf_dir, stages):
    long = "word " * 30_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no name, but some words here", None, None, 1), (None, "no name, but some words here", "en", "b", 1), (4, "same row", "fr", "a", 8), (4, "same row", "fr", "a", 8), (4, "other text of the same id", "fr", None, 8), (5, long, "de", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts = Counter((r[0], r[1]) for r in rows)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns == stages[name][2]
        got = Counter((r.doc_id, r.text) for r in out.collect())
        assert not got - texts, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        if name == "simhash_near_dedup":
            assert got == Counter({k: 1 for k in texts if k != (2, "")})
        elif name == "language_id":
            assert all(t and langid.LETTER.search(t) for _, t in got)
        elif name in ("substring_dedup", "decontamination"):
            assert got == texts
        else:
            assert all(r.taken > 0 for r in out.collect())
