"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree of style nodes (the path of block elements with
their classes and ids). Two things are counted per node over the host's pages: its
presentation styles (the sequences of its child elements) and, for the text under it, on how
many pages each text block stands. Presentation importance is the entropy of the styles,
content importance is one minus the mean entropy of the blocks (a block on one page only has
entropy 0, one on every page has entropy 1); a node's importance is their weighted sum.
Branches under the threshold are removed from every page of the host.

Every shown element of every page enters the tree; scripts, styles, heads and hidden elements
are not shown. What a page says about itself is a weight on a node's importance. An element
that states its part, by tag, role or a short class or id (menu, site header or footer, sidebar,
form, notice, advert, reader comments), has weight 0: such text is unwanted because of its
part, however unlike it is from page to page. A weaker word (related, share, search, ...), a
header inside the article, or a place outside the article that the page marks lowers the
importance, standing in the marked article raises it, and the tree decides. A form that holds
the page's own structure is a frame, not a form.

Pages of a host with the same main text (the blocks that no mark speaks against) are counted
as one, so a group of copies does not look like boilerplate. A node's importance on a host is
averaged with that of the equally named nodes of all hosts, which counts as ``corpus_pages``
pages: one formula for hosts of any size. A node on a single page has importance 1 by itself.

Counting is an aggregation by (host, node, block) hash with map-side combining, so a host
with a third of all pages reaches the reducers pre-aggregated; a block is counted at the
element that holds it, and the sums go up the tree. The text stays in its row: a page is
parsed once for the tree and once for its text, and only its removed nodes are joined back.

Defined results: a null or empty page has the empty text; a page without blocks too; broken
markup (missing end tags, cut references or tags) is read as browsers do for these cases; elements
nested deeper than ``DEPTH`` levels share the style node at that level, none of their text is lost; rows
that repeat a page get a result each; a null or odd URL has the empty host; other columns
pass through, columns named like an output are replaced.
"""

from __future__ import annotations

import functools
import html
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, drop_staged, each, group_apart, slices, staged

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# Element names by their part in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
PART_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu"}
PART_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "form"}
# words that state an element's part when they stand in a name of at most three words ...
PART_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "adbox", "banner", "sponsored", "nav", "navbar", "navigation",
              "menu", "breadcrumb", "breadcrumbs", "masthead", "topbar", "footer", "sidebar", "cookie", "cookies", "consent", "gdpr",
              "notice", "notices", "alert", "popup", "modal", "newsletter", "comment", "comments", "replies", "respond", "disqus"}
# ... unless one of these says that it is about something else, such as the page's layout
NOT_PART = {"no", "has", "have", "with", "without", "is", "non", "not"}
# words that make an element less likely to be main text
NOISE_NAMES = PART_NAMES | {"sponsor", "promo", "header", "aside", "widget", "related", "recommended", "overlay", "subscribe", "subscription",
                            "signup", "login", "search", "share", "social", "reply", "pagination", "pager", "toolbar", "copyright", "legal",
                            "disclaimer", "paywall", "teaser"}
STRUCTURE = re.compile(r"<(?:article|main|nav|header|footer|aside)\b", re.I)
ARTICLE_NAMES = {"article", "articlebody", "post", "postbody", "postcontent", "entrycontent", "maincontent", "story"}
#: Weights of a node's importance by what its element or one around it says of itself (nothing,
#: a weak name, a header, its part) and by where it stands (in no marked article, in, outside).
NAMED, HEADER, PART, UNSHOWN = 1, 2, 3, 4
MARK_WEIGHT = (1.0, 0.5, 0.35, 0.0)
PLACE_WEIGHT = (1.0, 2.0, 0.5)
#: Elements nested deeper than this are judged with the one around them at this depth.
DEPTH = 100
#: Start tags that end an open element of these names (up to the nearest block around it).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer",
          "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
WHITE = re.compile(r"[\s]+")


@functools.lru_cache(4096)
def _node(tag: str, attributes: str) -> tuple[str, int, bool]:
    """(style name, mark, does it mark the article) of a start tag."""
    at = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attributes)} if "=" in attributes else {}
    names = f"{at.get('class', '')} {at.get('id', '')}".split()
    split = [re.split(r"[-_]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", n).lower()) for n in names]
    tokens = {t for n, words in zip(names, split) for t in (n.lower(), *words)}
    part = any(len(w) <= 3 and PART_NAMES.intersection(w) and NOT_PART.isdisjoint(w) for w in split)
    role = at.get("role", "").lower()
    article = tag in ("article", "main") or role in ("main", "article") or any(re.sub(r"[-_]", "", n.lower()) in ARTICLE_NAMES for n in names)
    mark = 0
    if tag == "head" or "hidden" in attributes.lower().split():
        mark = UNSHOWN
    elif tag in PART_TAGS or role in PART_ROLES:
        mark = PART
    elif tag in ("body", "html") or article:
        mark = 0
    elif part:
        mark = PART
    elif tag == "header":
        mark = HEADER
    elif tokens & NOISE_NAMES:
        mark = NAMED
    return ".".join([tag, *sorted(set(names))]), mark, article and not mark


class Block:
    """A text block: its style path, the marks along the path, and whether it is in an article."""
    __slots__ = ("path", "marks", "text", "article")

    def __init__(self, path: tuple[str, ...], marks: tuple[int, ...], text: str, article: bool):
        self.path, self.marks, self.text, self.article = path, marks, text, article


def _main(found: list[Block]) -> list[Block]:
    """What the marks alone take for the main text: the blocks under no mark, of the marked
    article if there is one."""
    plain = [b for b in found if not (b.marks and b.marks[-1])]
    return [b for b in plain if b.article] or plain


def blocks(page: str | None) -> tuple[list[Block], dict[tuple[str, ...], list[str]]]:
    """The main text by the marks alone, by which copies of a page are found, and the styles."""
    found, styles = shown(page)
    return _main(found), styles


def shown(page: str | None) -> tuple[list[Block], dict[tuple[str, ...], list[str]]]:
    """The shown text blocks in page order, and the child sequence of each style node (repeats
    beside each other count once)."""
    out: list[Block] = []
    styles: dict[tuple[str, ...], list[str]] = {}
    stack: list[tuple[str, str, int, bool]] = []  # tag, style name, highest mark so far, in article
    held: list[str] = []
    count: Counter[str] = Counter()      # open elements by name: most tags close nothing
    page = page or ""

    def end_block() -> None:
        if held:
            text = WHITE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            mark, article = (stack[-1][2], stack[-1][3]) if stack else (0, False)
            if text and mark != UNSHOWN:
                marks = [s[2] for s in stack[:DEPTH]]
                marks[-1:] = [mark] if marks else []
                out.append(Block(tuple(s[1] for s in stack[:DEPTH]), tuple(marks), text, article))

    def close_from(i: int) -> None:
        end_block()
        for s in stack[i:]:
            count[s[0]] -= 1
        del stack[i:]

    at = 0
    while at < len(page):
        m = _MARKUP.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1]:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if tag in INLINE:
            continue
        if tag == "br":
            held.append(" ")
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1) if count[tag] else ():
                if stack[i][0] == tag:
                    close_from(i)
                    break
            continue
        if tag in ENDS_P and count["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close_from(i)
                    break
                if stack[i][0] in ("td", "th", "table", "button"):
                    break
        for i in range(len(stack) - 1, -1, -1) if any(count[t] for t in CLOSES.get(tag, ())) else ():
            if stack[i][0] in CLOSES[tag]:
                close_from(i)
                break
            if stack[i][0] in ("ul", "ol", "dl", "table", "div", "body"):
                break
        if tag == "body":
            while stack and stack[-1][0] == "head":
                close_from(len(stack) - 1)
        end_block()
        name, mark, article = _node(tag, m[3] or "")
        above = stack[-1] if stack else ("", "", 0, False)
        if tag == "form" and mark == PART and STRUCTURE.search(page, at, _form_end(page, at)):
            mark = 0
        elif mark == HEADER and not above[3]:
            mark = PART
        mark = max(mark, above[2])
        if mark != UNSHOWN:
            children = styles.setdefault(tuple(s[1] for s in stack[:DEPTH]), [])
            if not children or children[-1] != name:
                children.append(name)
        if tag not in VOID:
            count[tag] += 1
            stack.append((tag, name, mark, article or above[3]))
    end_block()
    return out, styles


def _form_end(page: str, at: int) -> int:
    end = _FORM_END.search(page, at)
    return end.start() if end else len(page)


_FORM_END = re.compile(r"</form\b", re.I)


@functools.lru_cache(1 << 14)
def _nodes(path: tuple[str, ...], marks: tuple[int, ...], place: int) -> tuple[tuple[int, tuple[str, ...]], ...]:
    """(hash, path) of a block's style nodes from the innermost outwards. The page's frame
    holds every block: it is judged by the text right in it only, as a node of its own. The
    lowest four bits of a hash are the node's mark and place."""
    frame = lambda name: name.split(".")[0] in ("html", "body")
    if not path or frame(path[-1]):
        path, marks = (*path, "#text"), (*marks, marks[-1] if marks else 0)
    return tuple((_hash(">".join(path[:i])) & ~15 | marks[i - 1] << 2 | place, path[:i])
                 for i in range(len(path), 0, -1) if not frame(path[i - 1]))


def _hash(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _judged(found: list[Block]) -> list[tuple[tuple[int, tuple[str, ...]], ...]]:
    """The nodes of every block of a page."""
    marked = any(b.article and not b.marks[-1] for b in found)
    return [_nodes(b.path, b.marks, (1 if b.article else 2) if marked else 0) for b in found]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per page with text: (_key, host, same, nodes, packed). ``same`` names its main
    text, ``packed`` has the presentation style of each node and the element of each block."""
    types = pa.schema([("_key", pa.int64()), ("host", pa.int64()), ("same", pa.int64()), ("nodes", pa.list_(pa.int64())), ("packed", pa.binary())])
    for b in slices(batches, "_html"):
        rows = []
        for key, host, page in zip(*(column(b, c).to_pylist() for c in ("_key", "_host", "_html"))):
            found, styles = shown(page)
            if not found:
                continue
            judged = _judged(found)
            at = {n: path for up in judged for n, path in up}
            place = {n: i for i, n in enumerate(at)}
            over = {up[i][0]: up[i + 1][0] for up in judged for i in range(len(up) - 1)}
            style = [_hash(">".join(styles.get(p, ()))) for p in at.values()]
            items = sorted({(place[up[0][0]], _hash(x.text)) for up, x in zip(judged, found)})
            leaf, item = zip(*items)
            packed = struct.pack("<ii", len(at), len(items)) + b"".join(np.array(v, t).tobytes() for v, t in (
                (list(at), "<i8"), (style, "<i8"), ([place.get(over.get(n), -1) for n in at], "<i4"), (leaf, "<i4"), (item, "<i8")))
            same = _hash("\0".join(x.text for x in _main(found) or found))
            rows.append((key, host, same, list(at), packed))
        cols = list(zip(*rows)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.types)], schema=types)


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, up, kind, item) of a page: each node's presentation style (kind 0) and each
    text block (kind 1); ``up`` is the node and those around it."""
    types = pa.schema([("host", pa.int64()), ("up", pa.list_(pa.int64())), ("kind", pa.int32()), ("item", pa.int64())])
    for b in slices(batches, "packed"):
        rows = []
        for host, raw in zip(column(b, "host").to_pylist(), column(b, "packed").to_pylist()):
            n, k = struct.unpack_from("<ii", raw)
            take, at = [], 8
            for count, t, width in ((n, "<i8", 8), (n, "<i8", 8), (n, "<i4", 4), (k, "<i4", 4), (k, "<i8", 8)):
                take.append(np.frombuffer(raw, t, count, at).tolist())
                at += count * width
            nodes, style, over, leaf, item = take
            ups = []
            for i in range(n):
                up = []
                while i >= 0:
                    up.append(nodes[i])
                    i = over[i]
                ups.append(up)
            rows += [(host, up, 0, x) for up, x in zip(ups, style)]
            rows += [(host, ups[i], 1, x) for i, x in zip(leaf, item)]
        cols = list(zip(*rows)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.types)], schema=types)


def _texts(pages: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for html_, gone in pages:
        out = []
        for page, drop in zip(each(html_), gone.to_pylist()):
            found, drop = shown(page)[0], set(drop or ())
            out.append("\n\n".join(b.text for b, up in zip(found, _judged(found)) if drop.isdisjoint(n for n, _ in up)))
        yield pa.array(out, pa.string())


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#\s]*)", 1), F.lit("")))


def importances(pages: DataFrame, weight: float, corpus_pages: int) -> DataFrame:
    """(host, node, m, importance) of the site style trees over rows of ``_pages``. ``weight`` is
    the share of content in a node's importance."""
    one = pages.groupBy("host", "same").agg(F.min("packed").alias("packed"))
    counts = (one.select("host", "packed").mapInArrow(_tree, "host bigint, up array<bigint>, kind int, item bigint")
              .groupBy("host", "up", "kind", "item").agg(F.count("*").alias("n")))
    # n log n sums give the entropies: a block on n of m pages has log_m n, styles -sum p log_m p
    own = counts.groupBy("host", "up").agg(*[
        F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0)).alias(name) for name, kind, x in (
            ("m", 0, F.col("n")), ("nlogn", 0, F.col("n") * F.log("n")), ("blocks", 1, F.col("n")), ("spread", 1, F.col("n") * F.log("n")))])
    itself = F.col("node") == F.col("up")[0]
    per = own.select("*", F.explode("up").alias("node")).groupBy("host", "node").agg(
        F.sum(F.when(itself, F.col("m")).otherwise(0.0)).alias("m"), F.sum(F.when(itself, F.col("nlogn")).otherwise(0.0)).alias("nlogn"),
        F.sum("blocks").alias("blocks"), F.sum("spread").alias("spread"))
    log_m = F.log("m")
    styles = F.greatest(F.lit(0.0), 1 - F.col("nlogn") / (F.col("m") * log_m))
    content = 1 - F.least(F.lit(1.0), F.col("spread") / (F.col("blocks") * log_m))
    here = F.when(F.col("m") <= 1, 1.0).otherwise((1 - weight) * styles + weight * content)
    per = staged(per.select("host", "node", "m", here.alias("here")), "trees")
    # hosts with one page say nothing about what repeats
    known = F.sum((F.col("m") - 1) * F.col("here")) / F.nullif(F.sum(F.col("m") - 1), F.lit(0.0))
    out = per.join(group_apart(per, ["node"], known.alias("known")).hint("shuffle_merge"), "node")
    code = lambda values, shift: F.element_at(F.array(*map(F.lit, values)), (F.shiftright("node", shift).bitwiseAND(3) + 1).cast("int"))
    place = F.when((F.shiftright("node", 2).bitwiseAND(3) > 0) & (F.col("node").bitwiseAND(3) == 1), 1.0).otherwise(code(PLACE_WEIGHT, 0))
    smooth = (F.col("m") * F.col("here") + corpus_pages * F.coalesce("known", "here")) / (F.col("m") + corpus_pages)
    return out.select("host", "node", "m", (code(MARK_WEIGHT, 2) * place * smooth).alias("importance"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", threshold: float = 0.3,
            corpus_pages: int = 4, weight: float = 0.9) -> DataFrame:
    """``pages`` plus ``text`` and ``n_chars`` (its code points)."""
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    key = F.xxhash64(F.coalesce(pages[url_col], F.lit("")), F.coalesce(pages[html_col], F.lit("")))
    rows = pages.select(*[pages[c].alias(f"in_{c}") for c in rest if c != html_col], pages[html_col].alias("_html"),
                        F.xxhash64(host_of(pages[url_col])).alias("_host"), key.alias("_key"))
    parsed = staged(rows.select("_key", "_host", "_html").mapInArrow(
        _pages, "_key bigint, host bigint, same bigint, nodes array<bigint>, packed binary"), "pages")
    low = staged(importances(parsed, weight, corpus_pages).where(F.col("importance") < threshold).select("host", "node"), "nodes")
    has = parsed.select("_key", "host", F.explode("nodes").alias("node"))
    gone = staged(has.join(low.hint("shuffle_merge"), ["host", "node"]).groupBy("_key").agg(F.collect_set("node").alias("gone")), "gone")
    drop_staged(parsed)
    out = rows.join(gone.hint("shuffle_merge"), "_key", "left")
    out = out.withColumn("text", F.arrow_udf(_texts, "string")("_html", "gone"))
    back = [F.col("_html").alias(c) if c == html_col else F.col(f"in_{c}").alias(c) for c in rest]
    return out.select(*back, "text").withColumn("n_chars", F.length("text").cast("long"))


def extract_digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
