"""Line-first quality rules (operator 2).

Each line is judged by itself: too many of its words carry stray punctuation, it is a strip of navigation separators, or it
is boilerplate. Failing lines are taken out; a document that loses too large a share of its words is rejected, and so
is one that fails the base rules. All is done in one pass beside the scan, on the UTF-8 bytes of whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, table

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_lines_removed long, n_words_removed long, kept boolean, cleaned string"
)
SYMBOLS = b"#*$%&|<>"
#: A word that only noise has: trailing runs of symbols or exclamation marks.
NOISY = re.compile(rb"(?:[#*$%&<>=~^]{2,}|!{2,})$")
BOILERPLATE = re.compile(
    rb"^\W*(?:cookie|cookies|we use cookies|accept all|javascript is|enable javascript|subscribe|sign up|sign in|log in|click here|read more"
    rb"|share this|follow us|terms of (?:use|service)|privacy policy|lorem ipsum|back to top|skip to)\b",
    re.IGNORECASE,
)
#: Shares, in percent: of noisy words and of separators in a line, and of words a document may lose.
NOISY_SHARE, SEPARATOR_SHARE, LOST_SHARE = 30, 20, 30
SEPARATORS = frozenset((b"|", b">", b"\xc2\xbb", b"/", b"-", b"\xe2\x80\xa2", b"\xc2\xb7"))


def line_fails(words: list[bytes], line: bytes) -> bool:
    """Punctuation, navigation and boilerplate, in this order; a line without words passes."""
    n = len(words)
    if not n:
        return False
    if 100 * sum(1 for w in words if NOISY.search(w)) > NOISY_SHARE * n:
        return True
    if n > 2 and 100 * sum(1 for w in words if w in SEPARATORS) > SEPARATOR_SHARE * n:
        return True
    return n <= 12 and BOILERPLATE.match(line) is not None


def judge(text: str | None) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    joined = b"".join(words)
    word_chars = len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    repeated = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            count, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeated += i + 3 - max(end, i)
                    end = i + 3
    seen: set[bytes] = set()
    dup = lost = gone = 0
    kept_lines = []
    for line in data.split(b"\n"):
        own = line.split()
        if own:
            if line in seen:
                dup += 1
            seen.add(line)
            if line_fails(own, line):
                gone += 1
                lost += len(own)
                continue
        kept_lines.append(line)
    failed = n < 50 or 100 * repeated > 50 * n
    kept = not failed and 100 * lost <= LOST_SHARE * n
    cleaned = b"\n".join(kept_lines).decode("utf-8", "surrogatepass") if kept else None
    return n, word_chars, symbols, dup, repeated, failed, gone, lost, kept, cleaned


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): base counts, lines and words removed, kept, and the cleaned text (null if rejected).

    A null or empty text has no words and fails the base rules. A null doc_id stays null, repeated rows are each judged, other
    columns are ignored, an empty table gives no rows. Texts of any length are judged whole.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64()] * 6 + [pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(judge(t.as_py()) for t in b.column(1)), strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types[1:], strict=True))], names=names)

    return bounded(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("cleaned")


SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
tri as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2)),
rep as (
  select r, count(distinct p) as n_repeat_words
  from (select r, unnest(range(i, i + 3)) as p from (select *, count(*) over (partition by r, g) as c from tri) where c > 1) group by r
),
l as (select r, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as lw from (select r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d)),
f as (
  select *, row_number() over (partition by r, line order by i) as k, len(lw) as n,
    len(list_filter(lw, lambda x: regexp_matches(x, '([#*$%&<>=~^]{2,}|!{2,})$'))) as noisy,
    len(list_filter(lw, lambda x: x in ('|', '>', '»', '/', '-', '•', '·'))) as seps,
    regexp_matches(line, '(?i)^[^a-zA-Z0-9_]*(cookie|cookies|we use cookies|accept all|javascript is|enable javascript|subscribe|sign up|sign in|log in|click here|read more|share this|follow us|terms of (use|service)|privacy policy|lorem ipsum|back to top|skip to)\b') as plate
  from l where len(lw) > 0
),
lines as (
  select r, count(*) filter (where k > 1) as n_dup_lines,
    count(*) filter (where 100 * noisy > 30 * n or (n > 2 and 100 * seps > 20 * n) or (n <= 12 and plate)) as n_lines_removed,
    cast(coalesce(sum(n) filter (where 100 * noisy > 30 * n or (n > 2 and 100 * seps > 20 * n) or (n <= 12 and plate)), 0) as bigint) as n_words_removed
  from f group by r
),
b as (
  select r, doc_id, cast(len(w) as bigint) as n_words, cast(len(array_to_string(w, '')) as bigint) as word_chars,
    cast(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols
  from w
)
select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  (n_words < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * n_words) as base_failed,
  coalesce(n_lines_removed, 0) as n_lines_removed, coalesce(n_words_removed, 0) as n_words_removed,
  (not (n_words < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * n_words) and 100 * coalesce(n_words_removed, 0) <= 30 * n_words) as kept
from b left join rep using (r) left join lines using (r)
"""
