"""Main text of pages by site template removal.

Every page is parsed once: its text is cut into blocks, and its container subtrees are hashed (tag,
class, id, text and the hashes of the children, from the leaves up), each with the range of blocks
that it holds. Spark counts on how many pages of a host each hash occurs; pages with equal
content count once, so that copies of an article do not look like a template. The ranges of
subtrees that recur on ``MIN_PAGES`` pages or more of their host are deleted from the blocks.
Paragraphs, headings, list items and table cells are never templates by themselves: lines that many
documents share stay.

Where too few pages of a host were seen, markup tells what is no article: navigation, footers,
asides, forms, scripts and so on by element or role. If a page marks its content (``article``,
else ``main``), only text in there is kept; inside of it names count only if a container is called
exactly an advert or reader comments. On other pages words in the class or id of an element count.

Edge cases: null and empty pages give an empty text; unclosed, misnested and cut markup is
closed as browsers close it (end of page closes all); null or odd urls share one empty host;
repeated rows give repeated rows and count once; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_etl.llm.common import prepare, slices, staged

#: A subtree is a template if it is on so many pages of a host with different content.
MIN_PAGES = 5

# a quote opens a value only behind '='; the end of the page ends a tag or comment
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')|=)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend",
          "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: What an element closes if it is open in the same container, and where that search ends.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
_FENCE = {"ul", "ol", "dl", "table", "select", "menu"}
_ENDS_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
_DROP = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas",
         "button", "select", "textarea", "title", "dialog", "menu", "noembed", "noframes", "datalist", "audio", "video", "map"}
_DROP_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
_DROP_NAME = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion",
              "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "notice", "notices", "alert", "newsletter", "subscribe", "signup",
              "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "share", "sharing", "social",
              "comment", "comments", "disqus", "respond", "related", "recommended", "widget", "toolbar", "masthead", "pagination", "pager",
              "login", "search", "copyright", "legal"}
_KEEP = {"html", "body", "article", "main"}
#: Whole names of containers that are no article inside of one.
_INSIDE_NAME = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "comments", "comment", "comment-list", "reader-comments"}
_CONTAINER = {"address", "aside", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "hgroup", "menu", "nav", "ol",
              "section", "table", "ul"}
#: Where a search for an element to close ends.
_ENDS_SEARCH = _FENCE | (_BLOCK - {"p", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead"})


class _Node:
    __slots__ = ("tag", "drop", "hash", "place", "mark", "begin", "end", "digest")

    def __init__(self, tag: str, drop: bool, place: int, mark: int, begin: int, name: str):
        self.tag, self.drop, self.place, self.mark, self.begin, self.end = tag, drop, place, mark, begin, -1
        self.hash = xxhash.xxh64(f"<{tag} {name}>")
        self.digest = 0


def _dropped(tag: str, attributes: str, inside: int) -> tuple[bool, str, bool]:
    """Whether markup tells that an element is no article; its class and id; whether it is the main role."""
    if tag in _DROP or tag == "header" and not inside:
        return True, "", False
    if not attributes or attributes.isspace():
        return False, "", False
    a = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    name = f"{a.get('class', '')} {a.get('id', '')}".strip()
    role = a.get("role", "")
    if tag in _KEEP and not (tag == "article" and "comment" in name):
        return False, name, role == "main"
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
    if inside:
        named = tag in _CONTAINER | {"article", "ins"} and bool(_INSIDE_NAME.intersection(name.split()))
    else:
        named = bool(_DROP_NAME.intersection(re.split(r"[^a-z]+", name)))
    return hidden or role in _DROP_ROLE or named, name, role == "main"


def parse(page: str | None) -> tuple[list, list[_Node]]:
    """Events in page order (text, or the number of a node that begins or ~number where it
    ends), and the nodes with their subtree hashes."""
    page = page or ""
    events: list = []
    nodes: list[_Node] = []
    stack: list[int] = []
    places: dict[str, list[int]] = {}       # places in the stack by tag, the innermost last
    fences: list[int] = []                  # and of elements that end a search
    articles = mains = 0

    def close(upto: int) -> None:
        nonlocal articles, mains
        while len(stack) > upto:
            i = stack.pop()
            n = nodes[i]
            places[n.tag].pop()
            if fences and fences[-1] == len(stack):
                fences.pop()
            n.end = len(events)
            events.append(~i)
            n.digest = n.hash.intdigest()
            if stack:
                nodes[stack[-1]].hash.update(n.digest.to_bytes(8, "little"))
            articles -= n.mark == 2
            mains -= n.mark == 1

    def text(t: str) -> None:
        if t:
            t = entities.unescape(t) if "&" in t else t
            events.append(t)
            if stack and not t.isspace():
                nodes[stack[-1]].hash.update(" ".join(t.split()))

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in _ENDS_P or tag in _CLOSES:
            want = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
            while True:
                d = max((places[t][-1] for t in want if places.get(t)), default=-1)
                if d < 0 or fences and fences[-1] > d:
                    break
                close(d)
                if not tag.startswith("t"):
                    break
        drop, name, main = _dropped(tag, m[3], articles + mains)
        mark = 2 if tag == "article" and not drop else 1 if tag == "main" or main else 0
        articles += mark == 2
        mains += mark == 1
        nodes.append(_Node(tag, drop, 2 if articles else 1 if mains else 0, mark, len(events), name))
        events.append(len(nodes) - 1)
        places.setdefault(tag, []).append(len(stack))
        if tag in _ENDS_SEARCH:
            fences.append(len(stack))
        stack.append(len(nodes) - 1)
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            close(len(stack) - 1)
        elif tag in _RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            raw = page[at:end.start() if end else size]
            nodes[-1].hash.update(raw)
            at = size if end is None else end.start()
    close(0)
    return events, nodes


def content_mark(nodes: list[_Node]) -> int:
    """2: the page has an article that is not part of something dropped, 1: a main element, 0: neither."""
    hidden = -1
    best = 0
    for n in nodes:
        if n.begin < hidden:
            continue
        if n.drop:
            hidden = n.end
        else:
            best = max(best, n.mark)
    return best


def lay_out(page: str | None) -> tuple[list[str], list[tuple[int, int, int, bool]]]:
    """Texts of the blocks of the main content in page order, and the container subtrees: hash, first
    block and behind the last one, and whether markup tells that it is no article (its text is in no
    block, nor that of anything outside of marked content)."""
    events, nodes = parse(page)
    mark, out, now = content_mark(nodes), [], []
    found, begins = [], {}

    def flush() -> None:
        t = " ".join("".join(now).split())
        now.clear()
        if t:
            out.append(t)

    i, inside = 0, 0
    while i < len(events):
        e = events[i]
        i += 1
        if isinstance(e, str):
            if inside or not mark:
                now.append(e)
            continue
        number = e if e >= 0 else ~e
        n = nodes[number]
        if n.tag in _BLOCK:
            flush()
        elif n.tag == "br" and e >= 0:
            now.append(" ")
        box = n.tag in _CONTAINER and not n.mark and n.end > n.begin + 1
        if e >= 0 and n.drop:
            if box:
                found.append((n.digest, len(out), len(out), True))
            i = n.end + 1
            continue
        if box and e >= 0:
            begins[number] = len(out)
        elif box:
            found.append((n.digest, begins.pop(number), len(out), False))
        if mark and n.mark == mark:
            inside += 1 if e >= 0 else -1
    flush()
    return out, found


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_LAID = "row long, host string, content long, blocks array<string>, boxes array<struct<hash:long,first:int,last:int,markup:boolean>>"
_BOX = pa.list_(pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("markup", pa.bool_())]))


def laid_out(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url`` and the layout of every page, written down: it is parsed once."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.monotonically_increasing_id().alias("row"),
                        host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            laid = [lay_out(page.as_py()) for page in b.column(4)]
            content = [_signed(xxhash.xxh64_intdigest("\n".join(blocks))) for blocks, _ in laid]
            boxes = [[(_signed(h), *rest) for h, *rest in found] for _, found in laid]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(content, pa.int64()), pa.array([x for x, _ in laid], pa.list_(pa.string())),
                                              pa.array(boxes, _BOX)], names=["key", "url", "row", "host", "content", "blocks", "boxes"])

    return staged(rows.mapInArrow(run, f"key {kind}, url string, {_LAID}"), "layouts", codec="zstd")


def _boxes(laid: DataFrame) -> DataFrame:
    return laid.select("row", "host", "content", F.explode("boxes").alias("b")).select("row", "host", "content", "b.*")


def templates_of(laid: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(``host``, ``hash``, ``pages``) of the subtrees that recur on many pages of a host."""
    seen = _boxes(laid).select("host", "hash", "content").distinct().groupBy("host", "hash").agg(F.count("*").alias("pages"))
    return seen.where(F.col("pages") >= min_pages)


def site_templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    return templates_of(laid_out(pages, url, url, html), min_pages)


def deletions(laid: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """How many subtrees are deleted, by what tells so: (``template``, ``markup``, ``n``)."""
    known = templates_of(laid, min_pages).select("host", "hash", F.lit(True).alias("template"))
    rows = _boxes(laid).join(known, ["host", "hash"], "left").select(F.coalesce("template", F.lit(False)).alias("template"), "markup")
    return rows.where(F.col("template") | F.col("markup")).groupBy("template", "markup").agg(F.count("*").alias("n"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """``key``, ``url`` and ``text`` of every page."""
    laid = laid_out(pages, key, url, html)
    known = staged(templates_of(laid, min_pages).select("host", "hash"), "templates")
    # only boxes that hold text of the result; only numbers are joined, and a page's own ranges gathered
    ranges = _boxes(laid).where(F.col("first") < F.col("last")).join(known, ["host", "hash"], "left_semi")
    gone = staged(ranges.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("gone")), "ranges")
    kept = F.filter("blocks", lambda t, i: ~F.exists("gone", lambda g: (g["first"] <= i) & (i < g["last"])))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(kept), "\n")
    return laid.join(gone, "row", "left").select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text"))
