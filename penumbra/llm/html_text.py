"""Main text of web pages (operator 7): site template removal.

A small tolerant parser turns each page into elements. Their subtrees are hashed (tag and text) and counted per host in
Spark; subtrees that recur on many pages of their host are deleted. Elements whose tag, role or class says that
they are no part of an article (menus, adverts, forms, ...) go as well; they are hashed and counted all the same.
Sites do repeat whole articles and passages: inside an article, a subtree counts once for each different article, and one of
more than PASSAGE words is no template.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, table

#: A subtree is a template on at least so many pages and at least that share of its host's pages.
LEAST_PAGES, LEAST_SHARE = 10, 0.3
#: On so many pages a subtree outside articles is a template whatever their share. Inside, the share decides: plain sentences recur in up to 36
#: different articles of the 320 pages of a host of sf0.1, and in more where there are more pages.
MANY_PAGES = 100
#: Words of prose inside an article up to which it can be a template.
PASSAGE = 30
#: Rows of template hits up to which they are broadcast to the pages; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|title|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[a-zA-Z/][^<>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside form fieldset button select menu dialog object canvas audio video map".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tr td th figure figcaption".split())
BLOCK = PROSE | frozenset("html body main article section div header address center details summary hr".split()) | DROPPED
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle adslot adbox adunit banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice alert notification announcement popup modal overlay paywall sidebar aside comment comments commentlist disqus discussion replies "
    "nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar share sharing social "
    "related newsletter subscribe subscription signup login pagination pager skip".split()
)
#: Names that make an article or main element none, and those that make a header of a site out of an element outside any.
NO_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments commentlist related teaser".split())
SITE = frozenset("site page top global main".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
#: Of the hash of a run of blocks.
BASE, PRIME = 0x9E3779B97F4A7C15, (1 << 61) - 1
STOPS = frozenset(("ul", "ol", "dl", "table", "article", "body", "html"))


def _unwanted(tag: str, attrs: str, inside: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|$|=)", attrs):
        return True
    for name, a, b, c in ATTR.findall(attrs):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id") and tag not in ("html", "body"):
            words = set(re.split(r"[^a-z0-9]+", value))
            if words & (NO_ARTICLE if tag in MAIN else NAMES) or not inside and "header" in words and (words & SITE or words == {"header"}):
                return True
    return False


class _Element:
    __slots__ = ("tag", "gone", "inside", "start", "heading_only")

    def __init__(self, tag: str, gone: bool, inside: bool, start: int, heading_only: bool):
        self.tag, self.gone, self.inside, self.start, self.heading_only = tag, gone, inside, start, heading_only


def digest(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(html: str | None) -> tuple[list[tuple[str, bool, str]], list[tuple[int, int, int, bool]]]:
    """Blocks (text, inside an article, text with what the names drop) in page order, and element subtrees (hash, first block, block after the last, inside).

    A block of which the names leave nothing has an empty text. Hashes of the blocks so far make that of any run of blocks a
    difference of two, so the time is in proportion to the page whatever its nesting.
    """
    blocks: list[tuple[str, bool, str]] = []
    subtrees: list[tuple[int, int, int, bool]] = []
    pieces: list[tuple[str, bool]] = []
    stack: list[_Element] = [_Element("", False, False, 0, False)]
    open_tags: Counter = Counter()
    sums, powers, n_words = [0], [1], [0]  # of the blocks before each

    def flush() -> None:
        if pieces:
            whole, left = (" ".join(unescape("".join(t for t, gone in pieces if some or not gone)).split()) for some in (True, False))
            if whole:
                blocks.append((left, stack[-1].inside, whole))
                sums.append((sums[-1] * BASE + digest(whole)) % PRIME)
                powers.append(powers[-1] * BASE % PRIME)
                n_words.append(n_words[-1] + len(whole.split()))
            pieces.clear()

    def close() -> None:
        flush_needed = stack[-1].tag in BLOCK
        if flush_needed:
            flush()
        e = stack.pop()
        open_tags[e.tag] -= 1
        n = len(blocks)
        if flush_needed and n > e.start and e.tag not in ("html", "body", "article", "main") and (not e.inside or n_words[n] - n_words[e.start] <= PASSAGE):
            content = (sums[n] - sums[e.start] * powers[n - e.start]) % PRIME
            subtrees.append((digest(f"{e.tag} {e.inside} {n - e.start} {content}"), e.start, n, e.inside))

    def take(text: str) -> None:
        top = stack[-1]
        if text:
            pieces.append((text, top.gone or top.heading_only and not any(e.tag[:1] == "h" and e.tag[1:].isdigit() for e in stack)))

    at, html = 0, html or ""
    for m in TOKEN.finditer(html):
        take(html[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "br":
                take(" ")
            if open_tags[tag] > 0:
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            take(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and open_tags["p"] > 0 and (k := next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p" or stack[k].tag in STOPS), 0)) and stack[k].tag == "p":
                while len(stack) > k:
                    close()
            if tag in SIBLINGS and any(open_tags[t] > 0 for t in SIBLINGS[tag]):
                stop = STOPS - {"table"} if tag in ("li", "dt", "dd") else STOPS
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in SIBLINGS[tag] or stack[k].tag in stop), 0)
                if k and stack[k].tag in SIBLINGS[tag]:
                    while len(stack) > k:
                        close()
        if tag in VOID:
            continue
        top = stack[-1]
        inside = top.inside or tag in MAIN or 'role="main"' in m["attrs"] or "articleBody" in m["attrs"]
        if not m["attrs"].endswith("/"):
            open_tags[tag] += 1
            stack.append(_Element(tag, top.gone or _unwanted(tag, m["attrs"], top.inside), inside, len(blocks), top.heading_only or tag == "header"))
    take(html[at:])
    while len(stack) > 1:
        close()
    flush()
    return blocks, subtrees


def main_text(html: str | None, templates: set[int] = frozenset()) -> str:
    blocks, subtrees = parse(html)
    gone = {i for h, a, b, _ in subtrees if h in templates for i in range(a, b)}
    left = [x for i, x in enumerate(blocks) if i not in gone and x[0]]
    if any(inside for _, inside, _ in left):
        left = [x for x in left if x[1]]
    return "\n\n".join(t for t, _, _ in left)


def page_subtrees(html: str | None) -> dict[int, tuple[int, bool]]:
    """Of each subtree of a page what it is counted by: 0, or the hash of the page's article for one inside that; and whether it is inside."""
    blocks, subtrees = parse(html)
    article = digest("\n".join(t for t, inside, _ in blocks if inside and t)) if any(s[3] for s in subtrees) else 0
    return {h: (article if inside else 0, inside) for h, _, _, inside in subtrees}


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url, text, n_chars; one row per row of pages (page_id, url, html).

    A null html counts as empty and has the text ''. A null url is a host of its own, as is one without a host. Pages that are cut off
    in a tag, comment or script end there. Repeated rows each give a row and count as pages of their host; a null page_id
    stays null; other columns are ignored; an empty table gives no rows. Nothing is capped.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    rows = bounded(pages).select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("of"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for host, of, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(host, of, h, article, inside) for h, (article, inside) in page_subtrees(html).items()]
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["host", "of", "subtree", "article", "inside"])

    found = rows.select("host", "of", "html").mapInArrow(hashes, "host string, of long, subtree long, article long, inside boolean")
    each = found.groupBy("host", "subtree", "article", "inside").agg(F.count("*").alias("n"))
    counted = each.groupBy("host", "subtree", "inside").agg(F.sum(F.when(F.col("inside"), 1).otherwise(F.col("n"))).alias("n"))
    total = rows.groupBy("host").agg(F.count("*").alias("pages"))
    templates = cut(counted.filter(f"n >= {least_pages}").join(total, "host").filter((F.col("n") >= least_share * F.col("pages")) | ~F.col("inside") & (F.col("n") >= MANY_PAGES)).select("host", "subtree"))
    n = templates.count()
    small = n <= BROADCAST_ROWS
    names = ["page_id", "url", "text", "n_chars"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(h, frozenset(t or ())) for h, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=names)

    none = F.array().cast("array<long>")
    if n == 0:
        rows = rows.select("page_id", "url", "html", none.alias("gone"))
    else:
        side = F.broadcast if small else (lambda d: d)
        hit = found.join(side(templates), ["host", "subtree"]).groupBy("of").agg(F.collect_set("subtree").alias("gone"))  # of one page's own elements
        rows = rows.join(hit, "of", "left").select("page_id", "url", "html", F.coalesce("gone", none).alias("gone"))
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
