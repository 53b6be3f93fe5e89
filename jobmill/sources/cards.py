"""Job cards around anchors (S06): company and location stand beside an aggregator's link, so
the page's element tree is needed. A small tolerant tree per page, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The link, the elements around it and the classes that hold company and location.
JOB_LINK = re.compile(r"/jobs/view/(\d+)")
COMPANY_CLASSES = ("job-card-container__company-name", "job-card-list__company-name", "base-search-card__subtitle")
LOCATION_CLASSES = ("job-card-container__metadata-item", "base-search-card__metadata", "job-search-card__location")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

CARD = "array<struct<job_id:string,title:string,company:string,href:string,location:string>>"
_CARD = pa.list_(pa.struct([(c, pa.string()) for c in ("job_id", "title", "company", "href", "location")]))


class _Node:
    __slots__ = ("tag", "parent", "classes", "href", "first", "last")

    def __init__(self, tag, parent, classes, href, first):
        self.tag, self.parent, self.classes, self.href = tag, parent, classes, href
        # the element holds the texts and the elements numbered first to last
        self.first = self.last = first


class _Page(HTMLParser):
    """Elements in page order, each with the stretch of texts and elements that it holds. An end
    tag closes the nearest open element of its name and all inside it; others are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.texts, self.open = [], [], []

    def handle_starttag(self, tag, attrs):
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        node = _Node(tag, self.open[-1] if self.open else None, given.get("class", "").split(), given.get("href"),
                     (len(self.nodes) + 1, len(self.texts)))
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                for node in self.open[k:]:
                    node.last = (len(self.nodes), len(self.texts))
                del self.open[k:]
                return

    def handle_data(self, data):
        if text := data.strip():
            self.texts.append(text)

    def done(self):
        self.close()
        for node in self.open:
            node.last = (len(self.nodes), len(self.texts))
        return self

    def text(self, node) -> str:
        return "".join(self.texts[node.first[1]:node.last[1]])

    def inside(self, node, classes) -> str:
        """Text of the first element inside ``node`` with one of the classes, or nothing."""
        for n in self.nodes[node.first[0]:node.last[0]]:
            if any(c in classes for c in n.classes):
                return self.text(n)
        return ""


def _above(node, *tags):
    """The nearest element around ``node`` of the first of the tags that there is."""
    for tag in tags:
        n = node.parent
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None:
            return n
    return None


def cards(html: str) -> list[dict]:
    """One card per job id, in order of first appearance; the last anchor of an id tells."""
    page = _Page()
    page.feed(html)
    page.done()
    found: dict[str, dict] = {}
    for a in page.nodes:
        m = JOB_LINK.search(a.href) if a.tag == "a" and a.href else None
        if m:
            box, item = _above(a, "div"), _above(a, "li", "div")
            found[m.group(1)] = {"job_id": m.group(1), "title": page.text(a), "href": a.href,
                                 "company": page.inside(box, COMPANY_CLASSES) if box else "",
                                 "location": page.inside(item, LOCATION_CLASSES) if item else ""}
    return list(found.values())


def job_cards(html: Column) -> Column:
    """The cards of a page; pages without such a link never leave the JVM."""
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([cards(p) if p else [] for p in pages.to_pylist()], _CARD)

    return F.arrow_udf(run, CARD)(F.when(html.contains("/jobs/view/"), html))
