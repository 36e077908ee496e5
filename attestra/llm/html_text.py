"""Main text of web pages, without what a site repeats on its pages.

A page is read into blocks of text and the element subtrees over them, and every subtree is
hashed with its text and its inner structure, whatever the markup says of it. Spark counts the distinct
pages of a host that have each hash. Subtrees on more than `min_pages` pages and `min_share` of
the host's are its template and go; so are, on small hosts, those on `few_pages` pages at
least and more than half of the host's. What stands within an article or main element is only taken for
template if more than half of the host's pages have it, since articles share passages, such as a
closing paragraph, that are their own text. Pages alike in all that the markup leaves of them
count as one, so copies of a page make no template.

What the markup names goes too: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments, those in articles of their own too. A class or id alone doesn't take away the main
element, nor the page's only article. Of the rest the article or main element is taken if there is one.

Reading takes time in proportion to the page, however deep its markup.

Defined results: null and empty html have an empty text; a page without html markup is one
text. A url without :// has an empty host, a host like any other. Repeated rows count as
one page and come back as often. A column named text gives way to the result; others don't matter.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import common as C
from attestra.llm.url_filters import host_of

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
#: Fixed by the HTML standard.
_RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "listing", "main", "menu", "nav", "ol", "p", "plaintext", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
_CLOSES_P = _BLOCK - {"body", "caption", "head", "html", "legend", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
#: What an opening tag closes, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_DROP = {
    "script", "style", "noscript", "template", "head", "title", "nav", "menu", "header", "footer", "aside", "form", "button", "select", "textarea", "input", "label", "fieldset",
    "iframe", "object", "embed", "applet", "canvas", "svg", "math", "audio", "video", "map", "dialog", "noembed", "noframes", "ins-ad",
}
_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "status"}
_DROP_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|ad|ads|adv|advert|adverts|advertisement|advertising|banner|promo|sponsor|sponsored|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comment|comments|reply|replies|disqus|breadcrumb|breadcrumbs|pagination|pager|toolbar|widget|skip-link|form)(?:$|[\s_-])",
    re.I,
)
#: Of an article's names: those of readers' comments.
_COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comment|comments|reply|replies|disqus)(?:$|[\s_-])", re.I)


@dataclass
class _Element:
    tag: str
    dropped: bool
    main: bool
    region: int  # of a class or id that takes it away
    first: int  # block that starts here or after
    hash: xxhash.xxh3_64 = field(default_factory=xxhash.xxh3_64)
    empty: bool = True


@dataclass
class Page:
    blocks: list[str]
    subtrees: list[tuple[int, int, int, bool]]  # hash, first block, block after the last, whether within an article
    hashes: list[int] = field(default_factory=list)  # of all subtrees, those without blocks too


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _dropped(tag: str, a: dict[str, str]) -> bool:
    if tag in _DROP or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in _DROP_ROLES:
        return True
    return "style" in a and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"], re.I))


def _named(a: dict[str, str]) -> bool:
    return bool(_DROP_NAMES.search(a.get("class", "")) or _DROP_NAMES.search(a.get("id", "")))


def parse(html: str) -> Page:
    """Blocks of the article in page order, and the subtrees of block elements over them."""
    blocks: list[tuple[str, bool, int]] = []  # text, in a main element, region
    subtrees: list[tuple[int, int, int, bool]] = []
    root = _Element("", False, False, 0, 0)
    stack, block_stack = [root], [root]
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    regions: list[list] = [[0, True]]  # the region around, whether it stays
    articles: list[int] = []  # regions of the page's articles
    comments: list[int] = []  # and of those named as comments
    inline: list[str] = []
    at, size = 0, len(html)

    def stays(region: int) -> None:
        while not regions[region][1]:
            regions[region][1] = True
            region = regions[region][0]

    def flush() -> None:
        text = " ".join("".join(inline).split())
        inline.clear()
        if text:
            top = block_stack[-1]
            top.hash.update(b"\0" + text.encode("utf-8", "surrogatepass"))
            top.empty = False
            if not stack[-1].dropped:
                blocks.append((text, stack[-1].main, stack[-1].region))

    def close(depth: int) -> None:
        """Close the elements above so many."""
        while len(stack) > depth:
            e = stack[-1]
            if e.tag in _BLOCK:
                flush()
                block_stack.pop()
                if not e.empty:
                    digest = e.hash.intdigest()
                    subtrees.append((digest - (1 << 64) if digest >> 63 else digest, e.first, len(blocks), e.main))
                    block_stack[-1].hash.update(b"\1" + e.tag.encode() + digest.to_bytes(8, "big"))
                    block_stack[-1].empty = False
            elif e.dropped and len(stack) > 1 and not stack[-2].dropped:
                flush_dropped()
            stack.pop()
            places[e.tag].pop()

    def flush_dropped() -> None:
        """Text of a dropped element within a block: for the hash, not for the text."""
        text = " ".join("".join(hidden).split())
        hidden.clear()
        if text:
            block_stack[-1].hash.update(b"\2" + text.encode("utf-8", "surrogatepass"))

    hidden: list[str] = []

    def text(part: str) -> None:
        if part and stack[-1].tag not in _RAW:
            (hidden if stack[-1].dropped and not block_stack[-1].dropped else inline).append(unescape(part))

    last = lambda tag: places[tag][-1] if places.get(tag) else 0

    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue  # inside raw text
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        rest = m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if last(tag):
                close(last(tag))
            continue
        if tag in _CLOSES_P and last("p") > max(last("table"), last("button")):
            close(last("p"))
        if tag in _CLOSES:
            shut, until = _CLOSES[tag]
            bound = max((last(t) for t in until), default=0)
            above = [places[t][k] for t in shut if places.get(t) and (k := bisect_right(places[t], bound)) < len(places[t])]
            if above:
                close(min(above))
        if tag in _BLOCK:
            flush()
        top = stack[-1]
        if tag in _RAW and not rest.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else size
            element = _Element(tag, True, False, top.region, len(blocks))
        elif tag in _VOID:
            if tag == "br":
                text(" ")
            continue
        else:
            a = _attributes(rest) if rest.strip(" /\n\t") else {}
            gone = top.dropped or _dropped(tag, a)
            main, region = tag == "main" or a.get("role", "").lower() == "main", top.region
            if not gone:
                named = bool(a) and _named(a)
                remark = named and tag == "article" and bool(_COMMENT_NAMES.search(f"{a.get('class', '')} {a.get('id', '')}"))
                if remark or named and tag not in ("html", "body", "article", "main"):
                    regions.append([region, False])
                    region = len(regions) - 1
                if remark:
                    comments.append(region)
                if main:
                    stays(region)
                if tag == "article" and not named:
                    articles.append(region)
            element = _Element(tag, gone, not gone and (top.main or main or tag == "article"), region, len(blocks))
        places.setdefault(tag, []).append(len(stack))
        stack.append(element)
        if tag in _BLOCK:
            block_stack.append(element)
    text(html[at:])
    close(1)
    flush()
    if len(articles) == 1:
        stays(articles[0])
    elif not articles and len(comments) == 1:
        stays(comments[0])
    for r in regions[1:]:
        r[1] = r[1] and regions[r[0]][1]
    kept = [b for b in blocks if regions[b[2]][1]]
    any_main = any(main for _, main, _ in kept)
    number, n = [], 0
    for _, main, region in blocks:
        number.append(n)
        n += regions[region][1] and (main or not any_main)
    number.append(n)
    hashes = sorted({h for h, _, _, _ in subtrees})
    subtrees = [(h, number[a], number[b], inner) for h, a, b, inner in subtrees if number[a] < number[b]]
    return Page([b for b, main, _ in kept if main or not any_main], subtrees, hashes)


def without(page: Page, template: dict[int, bool]) -> str:
    """The page's text without the template's subtrees; within articles without those alone that most pages have."""
    gone: set[int] = set()
    for h, a, b, inner in page.subtrees:
        if h in template and (template[h] or not inner):
            gone.update(range(a, b))
    return "\n".join(x for k, x in enumerate(page.blocks) if k not in gone)


def _plain(page: Page) -> bytes:
    return json.dumps([page.blocks, page.subtrees]).encode()  # without the hashes that no block has


def _unpack(data: bytes) -> Page:
    return Page(*json.loads(zstandard.decompress(data)))


def parsed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Stored: every row with a key of its own, its host, its packed page, the page's hash and its subtree hashes, and of those with text the ones outside and within articles; without the html."""
    names = [c for c in pages.columns if c != html_col]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def run(batches):
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [parse(x.as_py() or "") for x in batch.column(2)]
            keys = pa.array(range(key, key + len(found)), pa.int64())
            key += len(found)
            hashes = pa.array([p.hashes for p in found], pa.list_(pa.int64()))
            plain = [_plain(p) for p in found]
            same = pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in plain], np.uint64).view(np.int64))
            packed = pa.array([zstandard.compress(x, 3) for x in plain], pa.binary())
            holding = [pa.array([sorted({h for h, _, _, inner in p.subtrees if inner == wanted}) for p in found], pa.list_(pa.int64())) for wanted in (False, True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, packed, same, hashes, *holding], ["row", "host", "key", "page", "same", "hashes", "outer", "inner"])

    kind = rows.schema["row"].dataType.simpleString()
    return C.store(rows.mapInArrow(run, f"row {kind}, host string, key bigint, page binary, same bigint, hashes array<bigint>, outer array<bigint>, inner array<bigint>"), "parsed")


def templates(found: DataFrame, min_pages: int, min_share: float, few_pages: int) -> DataFrame:
    """(host, h, most, rows): subtrees on so many distinct pages of a host and so large a share of them; most: on more than half. rows counts copies too."""
    distinct = found.groupBy("host", "same").agg(F.first("hashes").alias("hashes"), F.count("*").alias("copies"))
    counts = distinct.select("host", "copies", F.explode("hashes").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).where(F.col("n") >= min(few_pages, min_pages + 1))
    pages = found.select("host", "same").distinct().groupBy(F.col("host").alias("of_host")).agg(F.count("*").alias("pages"))
    wide = (F.col("n") > min_pages) & (F.col("n") > min_share * F.col("pages"))
    most = (F.col("n") >= few_pages) & (2 * F.col("n") > F.col("pages"))
    return counts.join(pages, F.col("host") == F.col("of_host")).where(wide | most).select("host", "h", most.alias("most"), "rows")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = 10, min_share: float = 0.01, few_pages: int = 3) -> DataFrame:
    """The input's columns but html, and text: the main text, a line for each block."""
    names = [c for c in pages.columns if c != html_col]
    found = parsed(pages, url_col, html_col)
    of = F.xxhash64("host", "h").alias("of")  # h is a hash already
    recurring = C.store(templates(found, min_pages, min_share, few_pages).select(of, "h", "most", "rows"), "recurring")
    # Only what a template would take away is looked for, so pages without it aren't shuffled for it.
    held = lambda c, inner: found.select("key", "host", F.explode(c).alias("h")).select("key", of, F.lit(inner).alias("inside"))
    asked = held("outer", False).unionByName(held("inner", True))
    met = C.salted_join(asked, recurring.select("of", "h", "most"), "of", "key", recurring.select("of", F.col("rows").alias("n"))).where("most OR NOT inside")
    gone = C.store(met.groupBy("key").agg(F.collect_set(F.struct("h", "most")).alias("gone")), "templates")
    both = found.join(gone, "key", "left").select("row", "page", "gone")

    def run(batches):
        for batch in batches:
            texts = [without(_unpack(p.as_py()), {x["h"]: x["most"] for x in g.as_py() or ()}) for p, g in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    kind = found.schema["row"].dataType.simpleString()
    return both.mapInArrow(run, f"row {kind}, text string").select(*[F.col(f"row.`{c}`").alias(c) for c in names if c != "text"], "text")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    found = extract(C.read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
