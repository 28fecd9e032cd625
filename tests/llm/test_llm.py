"""The training-data operators against SQL, brute force, public libraries and planted cases; and odd rows."""

import math
import random
import zlib
from collections import Counter

import pytest
from conftest import same
from pyspark.sql import functions as F

from penumbra.llm import decontaminate, html_text, langid, lm_scores, mixing, quality_model, quality_rules, simhash, substrings, tokens
from penumbra.llm.queries import oracle_sql, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word" * 40_000


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names the operators use inside."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (None, "null id here", None, "b", 1), (None, "null id here", None, "b", 1), (4, "same row", "fr", "a", 8), (4, "same row", "fr", "a", 8), (5, LONG, "de", None, 9), (6, "x " * 20_000, "de", "a", 9), (7, "!!! 123 ### ½²", "es", "b", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("of", "n", "words", "fp", "score", "key", "range", "at", "root", "lang_pred", "held_out", "win", "size", "target"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert same(queries()[name](spark, sf_dir), duck.sql(oracle_sql()[name])) > 0


def words(text):
    return (text or "").encode().lower().split()


# operator 1


def brute_hits(docs, items, window=10):
    import regex

    split = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    wins = {}
    for item, t in items:
        w = split(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if got := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination_finds_every_shared_window(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    g = random.Random(1)
    voc = "a b c d e f é 1".split()
    items = [(k, " ".join(g.choices(voc, k=g.choice((0, 1, 3, 9, 10, 11, 25))))) for k in range(12)] + [(50, None)]
    docs = [(k, ", ".join(g.choices(voc, k=g.randrange(0, 60)) + (items[g.randrange(12)][1].split() if k % 2 else []))) for k in range(40)] + [(99, None)]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got.collect()), key=str) == brute_hits(docs, items)


def test_decontamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "same row"), (2, None), (None, "x x x")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    out = {(r.doc_id, r.n_hit): r.n_items for r in decontaminate.decontaminate(odd, items).collect()}
    assert out[4, 2] == 1 and out[6, 20_000] == 0
    assert decontaminate.decontaminate(odd, items).count() == odd.count()
    assert decontaminate.decontaminate(odd.limit(0), items).count() == 0
    assert decontaminate.decontaminate(odd, items.limit(0)).filter("contaminated").count() == 0
    left = decontaminate.drop_contaminated(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 3


# operator 2


def test_rules_keep_prose_and_drop_junk(spark, odd):
    g = random.Random(9)
    prose = "\n".join(" ".join("".join(g.choices("abcdefgh", k=6)) for _ in range(9)).capitalize() + "." for _ in range(12))
    junk = " ".join(f"w{k}###" for k in range(80))
    nav = " | ".join(f"w{k}" for k in range(80))
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame([(1, prose), (2, junk), (3, nav), (4, prose + "\nSubscribe now")], "doc_id long, text string")).collect()}
    assert [out[k].kept for k in (1, 2, 3, 4)] == [True, False, False, True]
    assert out[4].cleaned == prose and out[4].n_lines_removed == 1
    assert quality_rules.quality_rules(odd).count() == odd.count()
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


# operator 3


def test_token_counts_equal_the_library(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [r.text for r in docs.select("text").collect()] + ["a<|endoftext|>b", " \n\n x\t\ty's", "日本語 ½ 🙂🙂", "", "a" * 3000, "\x00\x1f\x85\xa0"]
    counter = tokens.Counter(path)
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    out = tokens.token_counts(odd, path)
    assert out.count() == odd.count() and out.filter("doc_id = 1").first().n_tokens == 0
    assert tokens.token_counts(odd.limit(0), path).count() == 0


# operator 4


def brute_groups(pairs, radius=4):
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(pairs):
        for j, (_, b) in enumerate(pairs[:i]):
            if (a ^ b).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(pairs))]


def test_vocabularies_of_other_kinds_are_refused(tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    tokens.refuse_other_kinds(spec)
    spec["model"]["merges"] = spec["model"]["merges"][:10]
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}, {"added_tokens": [{"content": "<x>", "lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="byte-level"):
            tokens.Counter(str(tmp_path / "t.json"))


def test_fingerprint_by_hand():
    from xxhash import xxh64_intdigest

    def slow(text):
        w = words(text)
        if not w:
            return 0
        h = [xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    for t in (None, "", "One", "a b c d", "a b c d e A B C d é", "x " * 50 + "y"):
        assert simhash.fingerprint(t) == slow(t)


def test_bit_sliced_comparison_is_exact():
    import numpy as np

    g = random.Random(2)
    base = [g.getrandbits(64) for _ in range(40)]
    fps = np.array(sorted({b ^ sum(1 << k for k in g.sample(range(64), g.randrange(8))) for b in base for _ in range(12)}), np.uint64)
    got = simhash.near_links(fps, 4)
    for i in range(len(fps)):
        near = np.bitwise_count(fps ^ fps[i]) <= 4
        near[: i + 1] = False
        assert (got[i] == near).all()


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    g = random.Random(11)
    a, b, c, d = (" ".join("".join(g.choices("abcdefghij", k=6)) for _ in range(40)) for _ in range(4))
    rows = [(3, b), (7, a), (7, b), (7, a), (9, a), (None, c), (None, c), (None, b), (None, d), (2, d), (4, None), (5, ""), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash")).withColumn("fp", F.lit("clash"))
    got = Counter((r.doc_id, r.text) for r in simhash.keep_one(df).collect())
    assert got == Counter([(3, b), (7, a), (None, c), (2, d), (4, None)])
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.keep_one(df).columns == df.columns


def test_groups_equal_brute_force(spark, docs, odd):
    for df in (docs, odd):
        out = simhash.simhash_groups(df).collect()
        pairs = [(r.doc_id, int(r.fingerprint, 16)) for r in out]
        assert [r.component_id for r in out] == brute_groups(pairs)
    assert simhash.simhash_groups(odd.limit(0)).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns


@pytest.mark.parametrize("blocks", [p[0] for p in simhash.PLANS])
def test_every_plan_of_blocks_is_exact(spark, monkeypatch, blocks):
    g = random.Random(blocks)
    base = [g.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << k for k in g.sample(range(64), g.randrange(6))) for b in base for _ in range(8)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    plan = next(p for p in simhash.PLANS if p[0] == blocks)
    monkeypatch.setattr(simhash, "PLANS", ((*plan[:2], 1 << 62),))
    monkeypatch.setattr(simhash, "CHUNK", 3)
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps))
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert [roots.get(x, x) for x in signed] == brute_groups(list(zip(signed, fps)))


# operator 5


def test_passages_that_repeat_are_removed_once(spark, odd):
    g = random.Random(3)
    voc = ["".join(g.choices("abcdefghij", k=6)) for _ in range(4000)]
    sent = lambda n: " ".join(g.choices(voc, k=n)).capitalize() + "."
    passage = " ".join(sent(11) for _ in range(6))
    rows = []
    for k in range(30):
        own = [sent(g.randrange(6, 18)) for _ in range(12)]
        if k % 3 == 0:
            own.insert(5, "and then " + passage + " but")
        rows.append((k, "\n".join(own[:6]) + "\n" + " ".join(own[6:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.has_repeats for r in substrings.substring_dedup(df).collect()}
    assert out == {k: k % 3 == 0 and k > 0 for k in range(30)}
    left = {r.doc_id: r.text for r in substrings.remove_repeats(df).collect()}
    assert sum(passage[60:-60] in t for t in left.values()) == 1
    assert all(left[k] == t for k, t in rows if k % 3 or k == 0)
    n = substrings.substring_dedup(odd).count()
    assert n == odd.count() and substrings.substring_dedup(odd.limit(0)).count() == 0
    assert substrings.remove_repeats(odd).columns == odd.columns


def test_near_paragraphs_collide_and_verify(spark, monkeypatch):
    g = random.Random(4)
    voc = ["".join(g.choices("abcdefghij", k=6)) for _ in range(4000)]
    base = [g.choices(voc, k=60) for _ in range(20)]
    rows = []
    for k, w in enumerate(base):
        other = list(w)
        other[0] = "changed"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substrings, "CHUNK", 1)
    assert substrings.similar_paragraphs(df).distinct().count() == 20
    monkeypatch.setattr(substrings, "CHUNK", 1 << 20)
    assert substrings.similar_paragraphs(df).distinct().count() == 20
    assert sorted(r.doc_id for r in substrings.substring_dedup(df).collect() if r.has_repeats) == [2 * k + 1 for k in range(20)]


def test_passages_are_cut_alike_in_any_host_and_are_caught_whole(spark):
    """Verbatim passages of 55 words, with and without marks, in hosts that share nothing else: at least 20 words of each later copy go, and nothing else does."""
    g = random.Random(7)
    word = lambda: "".join(g.choices("abcdefghijklmnop", k=7))

    def prose(n, marks):
        return " ".join(word() + (g.choice(marks) if g.random() < 0.2 else "") for _ in range(n))

    rows, planted = [], set()
    for k in range(60):
        marks = [".", ","] if k % 3 else [""]
        passage = prose(55, marks)
        for copy in range(2):
            rows.append((10 * k + copy, f"{prose(g.randrange(30, 90), marks)} {passage} {prose(g.randrange(30, 90), marks)}"))
        planted.add(10 * k + 1)
        rows.append((10 * k + 2, prose(150, marks)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.words_removed for r in substrings.substring_dedup(df).collect()}
    caught = {k for k, n in got.items() if n}
    assert caught <= planted and len(caught) >= 0.95 * len(planted)
    assert all(got[k] <= 75 for k in caught)


def test_rows_of_one_id_are_cut_by_their_own_paragraphs(spark):
    g = random.Random(9)
    text = lambda n: " ".join("".join(g.choices("abcdefghijklmnop", k=7)) for _ in range(n)) + "."
    a, b, c = text(30), text(30), text(30)
    df = spark.createDataFrame([(1, b), (2, b + "\n" + a), (2, c), (3, a), (3, a), (None, b)], "doc_id long, text string")
    left = sorted((r.doc_id or 0, r.text) for r in substrings.remove_repeats(df).collect())
    assert left == sorted([(0, b), (1, b), (2, a), (2, c)])
    got = sorted((r.doc_id or 0, r.has_repeats) for r in substrings.substring_dedup(df).collect())
    assert got == [(0, False), (1, False), (2, False), (2, True), (3, True), (3, True)]


def test_sets_of_shingles_name_paragraphs_and_short_ones_have_no_bands():
    a, b, c = (substrings.Chunk([t]) for t in (b"a a a a a a", b"a a a a a a a", b"a a a a a b"))
    assert a.whole[0] == b.whole[0] != c.whole[0]
    assert len(substrings.Chunk([b"a b c d e f g h."]).comparable(0.8)) == 1 and len(substrings.Chunk([b"a b c d e f g."]).comparable(0.8)) == 0
    assert substrings.cuts("") == [] and substrings.cuts("x, y z. w") == [3, 4]


def test_jaccard_is_exact():
    import numpy as np

    g = random.Random(5)
    sets = [np.unique(np.array(g.sample(range(30), 12) if k % 2 else list(range(k % 5, k % 5 + 12)), np.uint64)) for k in range(30)]
    root = list(range(30))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(30):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    want = Counter(find(i) for i in range(30))
    joined = list(range(30))

    def top(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b in substrings._similar(list(range(30)), sets, 0.8):
        joined[top(a)] = top(b)
    assert sorted(Counter(top(i) for i in range(30)).values()) == sorted(want.values())


# operator 6


def test_language_accuracy_and_unknown(spark, docs, odd):
    out = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)
    got = langid.language_id(odd).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 7)} == {"und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert langid.language_id(odd.limit(0)).count() == 0


def test_language_model_ignores_held_out_labels(docs):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    changed = docs.withColumn("lang", F.when(fold == 0, F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.language_id(d).collect()) for d in (docs, changed))
    assert a == b


def test_language_scores_equal_brute_force(docs, odd):
    import unicodedata

    low = (1 << 64) - 1

    def buckets(text):
        code = [ord(c) for c in text.lower()]
        for i in range(len(code)):
            h = 0
            for k in range(1, min(3, len(code) - i) + 1):
                h = (h + code[i + k - 1] + k) * 0x9E3779B97F4A7C15 & low
                h ^= h >> 29
                yield (h * 0xBF58476D1CE4E5B9 & low) >> 49

    both = docs.unionByName(odd.select(*docs.columns))
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    every = both.collect()
    counts, rows = {}, Counter()
    for r in every:
        if not held(r.doc_id) and r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(buckets(r.text))
            rows[r.lang] += 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    want = []
    for r in every:
        if not any(unicodedata.category(c)[0] == "L" for c in r.text or ""):
            want.append((r.doc_id or -1, held(r.doc_id), "und", 0.0))
            continue
        own = Counter(buckets(r.text))
        logs = {x: math.log(rows[x] / sum(rows.values())) + sum(n * math.log((c[b] + 1) / (total[x] + 2**15)) for b, n in own.items()) for x, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        want.append((r.doc_id or -1, held(r.doc_id), best, round(1 / sum(math.exp(v - logs[best]) for v in logs.values()), 5)))
    got = [(r.doc_id or -1, r.held_out, r.lang_pred, round(r.score, 5)) for r in langid.language_id(both).collect()]
    assert sorted(got) == sorted(want)


# operator 7


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><header>Top</header><article><h1>Title &amp; more</h1><p>One   two<br>three <b>fo</b>ur.<p>Second &lt;para&gt;
text.</p><ul><li>item one<li>item two</ul></article><section class="comments"><p>First!</p></section><aside>Side</aside><form>Name</form><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more\n\nOne two three four.\n\nSecond <para> text.\n\nitem one\n\nitem two"


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == TEXT
    assert html_text.main_text(None) == "" == html_text.main_text("<nav>x</nav><p")
    assert html_text.main_text("<article><p>cut &am") == "cut &am"
    assert html_text.main_text("a < b & c") == "a < b & c"
    more = "<div class='site-header'>H</div><div id='page'><article class='post'><header class='entry-header'>by me<h2>T</h2></header><p>Text.<div class='ad-slot'>buy</div></article><article class='comment'><p>me too</article></div><div class=alert>!</div>"
    assert html_text.main_text(more) == "T\n\nText."


def test_templates_of_a_host_go(spark):
    page = lambda k: f"<body><div><p>Shared banner words</p></div><p>Own text {k}.</p><div>{'other' if k % 2 else 'more'} {k}</div></body>"
    rows = [(k, "http://h/x", page(k)) for k in range(12)] + [(99, None, page(99)), (100, "http://other/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("of", F.lit(1))
    out = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert out[3] == "Own text 3.\n\nother 3" and out[99].startswith("Shared banner") and out[100] == ""
    assert html_text.extract(df.limit(0)).count() == 0
    assert html_text.extract(df.union(df)).count() == 2 * len(rows)


def test_unnamed_templates_inside_articles_go(spark):
    """Short boilerplate in different articles goes, and on large hosts that outside; articles that are copied, and passages, stay."""
    passage = "words of a passage that the site quotes again and again " * 4
    page = lambda own: f"<body><article><h1>T {own}</h1><p>Own text {own}.</p><p>{passage}</p><p>Follow us today</p><ul><li>one<li>two</ul></article></body>"
    rows = [(k, "http://h/x", page(k)) for k in range(12)] + [(100 + k, "http://copies/x", page(0)) for k in range(12)]
    rows += [(1000 + k, "http://large/x", f"<body>{'<div>Get our app</div>' if k < 110 else ''}<p>Text {k}.</p></body>") for k in range(500)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == f"T 3\n\nOwn text 3.\n\n{passage.strip()}" and out[1003] == "Text 3."
    assert out[103].endswith("Follow us today\n\none\n\ntwo") and out[103].startswith("T 0\n\nOwn text 0.")
    assert out[1400] == "Text 400."


def test_deep_pages_take_time_in_proportion_and_odd_rows_have_rows(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert html_text.main_text("<div>x " * n).count("x") == n
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1
    rows = [(None, None, None), (None, "u", ""), (1, "//h/a", "<p>" + "long " * 200_000), (1, "//h/a", "<p>twice</p>"), (1, "//h/a", "<p>twice</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("of", F.lit("clash"))
    got = sorted(html_text.extract(pages).collect(), key=str)
    assert sorted(r.n_chars for r in got) == [0, 0, 5, 5, 999_999]
    assert all(len(r.text) == r.n_chars for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_articles_on_real_pages(spark, sf_dir):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", html[r.page_id], re.S)
        body = re.sub(r"<[a-z/!][^>]*$", "", m[1]) if m else ""
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# operator 8


@pytest.mark.parametrize("kw", [{}, {"classes": 20, "broadcast_words": 100}])
def test_base_scores_equal_brute_force(docs, kw):
    rows = docs.select("doc_id", "text").collect()
    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update([*words(r.text), b""])
    n, v = sum(counts.values()), len(counts)
    out = {r.doc_id: r for r in lm_scores.lm_scores(docs, **kw).collect()}
    for r in rows:
        own, got = [*words(r.text), b""], out[r.doc_id]
        assert got.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert (got.n_tokens, got.n_known, got.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_prefer_what_predicts():
    import numpy as np

    bucket = np.array([3, 3, 5, 5, 0])
    ratio = np.array([50.0, 40.0, 0.0, 0.01, 9.0])
    lam = lm_scores.word_weights(bucket, ratio, np.full(5, 1000.0))
    assert lam[3] > 0.9 and lam[5] < 0.05 and lam[0] == 0 and ((lam >= 0) & (lam < 1)).all()


def test_packed_numbers_come_back():
    import numpy as np

    g = np.random.default_rng(8)
    x, y, z = np.sort(g.integers(0, 1 << 63, 1000).astype(np.uint64)), g.integers(-(1 << 62), 1 << 62, 7), g.random(50).astype(np.float32)
    back = lm_scores.unpack(lm_scores.pack(lm_scores.steps(x), y, z), (1000, np.uint64), (7, np.int64), (50, np.float32))
    assert (np.cumsum(back[0]) == x).all() and (back[1] == y).all() and (back[2] == z).all()
    assert len(lm_scores.unpack(lm_scores.pack(x[:0]), (0, np.uint64))[0]) == 0


def test_keys_of_words_agree(spark):
    words_ = [b"a", "\u00e9t\u00e9".encode(), b"x" * 100]
    got = spark.createDataFrame([(bytearray(w),) for w in words_], "word binary").select(F.expr(lm_scores.KEY)).collect()
    assert [r[0] for r in got] == [lm_scores.Codes()[w] for w in words_]


def test_scores_of_odd_rows(spark, odd):
    out = lm_scores.lm_scores(odd).collect()
    assert len(out) == odd.count()
    assert {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert len({(r.score, r.base_score) for r in out if r.doc_id == 4}) == 1
    assert lm_scores.lm_scores(odd.limit(0)).count() == 0
    held = spark.createDataFrame([(k, "a b") for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2], "doc_id long, text string")
    assert {r.train_tokens for r in lm_scores.lm_scores(held).collect()} == {0}


@pytest.mark.parametrize("kw", [{}, {"classes": 4, "broadcast_words": 8}])
def test_scores_use_bigrams_of_rare_words(spark, kw):
    """Of two held-out texts of the same rare words, the one in the order that training has scores higher."""
    common = " ".join(f"w{k}" for k in range(30))
    rare = [f"r{k}" for k in range(40)]
    texts = {k: common if k % 2 else " ".join(rare) for k in range(200) if zlib.crc32(str(k).encode()) % 7 != 2}
    a, b = [k for k in range(200) if k not in texts][:2]
    filler = [(1000 + k, f"x{k} " * 3) for k in range(2500) if zlib.crc32(str(1000 + k).encode()) % 7 != 2]  # three each, more than the classes
    more = [(5000 + k, " ".join(f"x{j} x{j}" for j in range(2500))) for k in range(40) if zlib.crc32(str(5000 + k).encode()) % 7 != 2]
    rows = [*texts.items(), *filler, *more, (a, "r0 r1 r2 r3"), (b, "r2 r0 r3 r1")]
    docs = spark.createDataFrame([r for r in rows if r[0] in (a, b) or r[0] >= 1000 or r[0] % 2 or r[0] < 24], "doc_id long, text string")
    out = {r.doc_id: r for r in lm_scores.lm_scores(docs, **kw).collect()}
    assert out[a].held_out and out[a].base_score == pytest.approx(out[b].base_score)
    assert out[a].score > out[b].score + 2


def test_scores_equal_brute_force(spark, monkeypatch):
    """Word bigrams of any frequency, whether their words are classes, broadcast or joined; the brute force's probabilities sum to one."""
    monkeypatch.setattr(lm_scores, "FINE", 512)  # the brute force learns from exact ratios
    docs = [(k, t) for k, t in enumerate(["a b c d e", "a b d c", "b c a e f", "g a b h", "d e a b", "i j k a b"] * 8) if zlib.crc32(str(k).encode()) % 7 != 2]
    kinds = "a b c d e f g h i j k".split()
    ids = [k for k in range(10_000, 11_000) if zlib.crc32(str(k).encode()) % 7 == 2]
    after = lambda c: [(ids.pop(), f"{c} {w}") for w in [*kinds, "zzz"]] + [(ids.pop(), c)]
    probes = {c: after(c) for c in ("a", "h", "k")}
    ends = {w: (ids.pop(), w) for w in [*kinds, "zzz"]}
    table = spark.createDataFrame([*docs, *[r for p in probes.values() for r in p], *ends.values()], "doc_id long, text string")
    rows = {r.doc_id: r.score for r in lm_scores.lm_scores(table, classes=3, broadcast_words=6).collect()}
    brute = _brute_lm(docs)
    for r in [r for p in probes.values() for r in p] + list(ends.values()):
        assert rows[r[0]] == pytest.approx(brute(r[1]), abs=1e-3)


def _brute_lm(docs):
    """The model of operator 8 over dicts: (text -> log10 P), its weights learned as in lm_scores but from exact ratios."""
    import numpy as np

    split = [([*words(t), b""], zlib.crc32(str(k).encode()) % 7 == 0) for k, t in docs]
    count, gone, pairs, pairs_gone = Counter(), Counter(), Counter(), Counter()
    for own, d in split:
        two = list(zip([b"", *own], own))
        count.update(own)
        pairs.update(two)
        if d:
            gone.update(own)
            pairs_gone.update(two)
    left = Counter({w: count[w] - gone[w] for w in count})
    total, rest, kinds = sum(count.values()), sum(left.values()), len(count)
    ratio = np.array([left[w] / rest * (kinds + 1) for w in gone])
    mix = lm_scores.word_weights(np.ones(len(gone), int), ratio, np.array([float(gone[w]) for w in gone]))[1]
    single = lambda n, of: mix * n / of + (1 - mix) / (kinds + 1)
    seen = list(pairs_gone)
    b = lm_scores.buckets(np.array([left[c] for c, _ in seen]))
    r = np.array([(pairs[c, w] - pairs_gone[c, w]) / max(1, left[c]) / single(left[w], rest) for c, w in seen])
    lam = lm_scores.word_weights(b, r, np.array([float(pairs_gone[p]) for p in seen]))

    def p(c, w):
        k = lam[lm_scores.buckets(np.array([count[c]]))[0]]
        return (1 - k) * single(count[w], total) + (k * pairs[c, w] / count[c] if count[c] else 0)

    for c in [*list(count)[:20], b"zzz"]:
        assert sum(p(c, w) for w in [*count, b"zzz"]) == pytest.approx(1, abs=1e-9)
    return lambda text: sum(math.log10(p(c, w)) for c, w in zip([b"", *words(text)], [*words(text), b""]))


@pytest.mark.parametrize("kw", [{}, {"classes": 20, "broadcast_words": 300}])
def test_scores_of_the_table_equal_brute_force(docs, monkeypatch, kw):
    """Every document of the test table, in many small chunks and buckets."""
    monkeypatch.setattr(lm_scores, "FINE", 1 << 14)  # the brute force learns from exact ratios
    monkeypatch.setattr(lm_scores, "CHUNK_TOKENS", 5000)
    rows = docs.select("doc_id", "text").collect()
    brute = _brute_lm([(r.doc_id, r.text) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2])
    got = {r.doc_id: r.score for r in lm_scores.lm_scores(docs, **kw).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == pytest.approx(brute(r.text), rel=1e-5)


# operator 9


def test_mix_meets_targets_and_reruns_agree(spark, odd):
    g = random.Random(7)
    rows = [(k, " ".join(["w"] * g.randrange(1, 30)), g.choice(["a"] * 9 + ["b", None, "zz"])) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = mixing.mix(df).collect()
    b = mixing.mix(df.repartition(7)).collect()
    key = lambda r: r.doc_id
    assert sorted(a, key=key) == sorted(b, key=key)
    taken, goal, size = Counter(), {}, {}
    for r in a:
        taken[r.source] += r.taken
        goal[r.source], size[r.source] = r.target, r.source_size
        assert 0 <= r.taken <= 3 * r.size
    assert all(taken[s] == math.floor(goal[s]) for s in goal)
    assert all(goal[s] <= 3 * size[s] + 1e-9 for s in goal) and sum(goal.values()) == pytest.approx(sum(size.values()))
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).first().taken == 0


# operator 10


def test_quality_accuracy_and_odd_rows(spark, sf_dir, docs, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality_model.quality_scores(big, labels).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.9 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    small = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    assert quality_model.quality_scores(odd, small).count() == odd.count()
    assert {r.score for r in quality_model.quality_scores(odd, small.limit(0)).collect()} == {0.5}
    assert quality_model.quality_scores(odd.limit(0), small).count() == 0


def test_flattened_trees_equal_a_walk():
    import numpy as np

    g = np.random.default_rng(8)
    x = g.normal(size=(400, quality_model.FEATURES))
    y = (x[:, 3] + x[:, 5] > 0).astype(float)
    model = quality_model.fit(x, y, 10)

    def walk(row):
        out = model.base
        for f, c, v in zip(model.feature, model.cut, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            out += v[node - len(f)]
        return 1 / (1 + math.exp(-out))

    got = model.predict(x)
    assert np.allclose(got[:50], [walk(r) for r in x[:50]])
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.85


def test_boosted_trees_equal_brute_force():
    """Every split has the best gain of all features and cuts, every leaf its Newton step."""
    import numpy as np

    g = np.random.default_rng(3)
    x = g.normal(size=(300, 4)).round(1)
    y = (x[:, 0] * x[:, 1] + 0.3 * g.normal(size=300) > 0).astype(float)
    model = quality_model.fit(x, y, 3)
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, 65)[1:-1]))) for c in x.T]
    out = np.full(300, math.log(y.mean() / (1 - y.mean())))
    assert model.base == pytest.approx(out[0])

    def gain(rows, f, c, grad, curv):
        left = [r for r in rows if x[r, f] <= c]
        right = [r for r in rows if x[r, f] > c]
        if min(len(left), len(right)) < 10:
            return 0.0
        part = lambda own: sum(grad[r] for r in own) ** 2 / (sum(curv[r] for r in own) + 1)
        return part(left) + part(right) - part(rows)

    def follow(tree, rows, node, grad, curv):
        if node >= 15:
            value = -0.15 * sum(grad[r] for r in rows) / (sum(curv[r] for r in rows) + 1)
            assert model.value[tree][node - 15] == pytest.approx(value, abs=1e-9)
            out[rows] += value
            return
        f, c = model.feature[tree][node], model.cut[tree][node]
        best = max(gain(rows, i, v, grad, curv) for i in range(4) for v in cuts[i])
        assert (gain(rows, f, c, grad, curv) if c < math.inf else 0) == pytest.approx(max(best, 0), abs=1e-6)
        follow(tree, [r for r in rows if not x[r, f] > c], 2 * node + 1, grad, curv)
        follow(tree, [r for r in rows if x[r, f] > c], 2 * node + 2, grad, curv)

    for tree in range(3):
        p = 1 / (1 + np.exp(-out))
        follow(tree, list(range(300)), 0, p - y, p * (1 - p))
    assert np.allclose(model.predict(x), 1 / (1 + np.exp(-out)))


def test_repeats_of_a_labelled_id_do_not_pile_up(spark):
    docs = spark.createDataFrame([(1, f"text {k % 30}") for k in range(900)] + [(2, "same")] * 900, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    fit = quality_model.fit
    quality_model.fit = lambda x, y: seen.append(len(y)) or fit(x, y)
    try:
        quality_model.train(docs, labels)
        quality_model.train(docs, labels, 10)
    finally:
        quality_model.fit = fit
    assert seen[0] <= 31 and seen[1] <= 25
