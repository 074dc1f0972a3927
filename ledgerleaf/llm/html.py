"""Main text of web pages by tree scoring: paragraphs give points to their ancestors, link density takes them away."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose content is never the article's.
DROPPED = {"script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select", "textarea", "option", "iframe", "object", "svg", "canvas", "dialog", "menu", "audio", "video", "header"}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words of a class or id that name what is not the article, and the points they cost. An element at GOES goes however much
#: its paragraphs earn (a long discussion is none the more the article), unless it is the article's own wrapper; another
#: stays all the same if they earn more.
GOES = -200.0
NAMES = {
    w: cost
    for cost, words in {
        GOES: "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies gdpr nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar "
        "footer comment comments commentlist discussion disqus replies newsletter share sharing",
        -25.0: "promotion banner consent notice alert popup modal overlay aside widget related recommended social follow header masthead copyright reply respond subscribe subscription signup login search hidden",
    }.items()
    for w in words.split()
}
#: Elements that start a block of text of their own; also those that end an open paragraph.
BLOCKS = set("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | (DROPPED - {"button", "select", "textarea", "option", "iframe", "object", "svg", "canvas", "audio", "video", "script", "style", "noscript", "template"})
#: An element of the first kind is closed by a later sibling of any of the second.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
KEPT = {"html", "body", "main", "article"}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "dd", "li"}
#: Ancestors that get all points of the paragraphs within, however deep; others get a half, a third and so on.
WHOLE = {"article"}
START_POINTS = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "form": -3.0}
#: What lies outside all elements that go must earn so many points, about a paragraph, or there is no other article.
LEAST_OUTSIDE = 3.0
#: Bytes of pages that a task reads at once.
SLICE = 4 << 20
_TAIL = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
_SPACE = re.compile(r"\s+")


class Node:
    """An element: its children are nodes and strings, in page order."""

    __slots__ = ("block", "children", "cost", "dropped", "links", "parent", "points", "size", "tag", "whole")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, cost: float = 0.0):
        self.tag, self.parent, self.dropped, self.cost = tag, parent, dropped, cost
        self.children: list[Node | str] = []
        self.points, self.size, self.links = 0.0, 0, 0
        #: The nearest element, itself included, that is a block of text, and that gets all points from below.
        self.block: Node | None = self if parent is None or tag in BLOCKS else parent.block
        self.whole: Node | None = self if tag in WHOLE else parent.whole if parent else None


def _dropped(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in KEPT:
        return False
    if tag in DROPPED:
        return True
    for name, value in attrs:
        value = (value or "").lower()
        if name == "role" and value.strip() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _cost(tag: str, attrs: list[tuple[str, str | None]]) -> float:
    """What the names of an element cost: those of its dearest word."""
    if tag in KEPT - {"article"}:
        return 0.0
    # Of an article only whole names count: each comment of a discussion may be one.
    words = (w for name, value in attrs if name in ("class", "id") for w in re.split(r"\s+" if tag == "article" else r"[^a-z0-9]+", (value or "").lower()))
    return min((NAMES.get(w, 0.0) for w in words), default=0.0)


class Tree(HTMLParser):
    """A forgiving tree builder: missing end tags close where HTML's rules close them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        #: How many elements of each tag are open, so that no search for one goes all the way up in vain.
        self.open: Counter[str] = Counter()

    def _close(self, tags: set[str], within: set[str]) -> None:
        node = self.at
        if not any(self.open[t] for t in tags):
            return
        while node.parent is not None and node.tag not in within:
            if node.tag in tags:
                self._leave(node)
                return
            node = node.parent

    def _leave(self, node: Node) -> None:
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[node.tag] -= 1
        self.at = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag in BLOCKS:
            self._close({"p"}, {"td", "th", "table", "button", "object"})
        if tag in CLOSED_BY:
            self._close({k for k, v in CLOSED_BY.items() if tag in v}, SCOPES[tag])
        node = Node(tag, self.at, _dropped(tag, attrs), _cost(tag, attrs))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while self.open[tag] and node.parent is not None:
            if node.tag == tag:
                self._leave(node)
                return
            if tag not in KEPT and node.tag in {"article", "main", "body"} or tag in {"b", "i", "a", "span", "em", "strong"} and node.tag in BLOCKS:
                return  # a stray end tag doesn't close what stands around
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(_TAIL.sub("", html))
    tree.close()
    return tree.root


def _nodes(root: Node) -> list[Node]:
    """All nodes outside dropped ones, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            out.append(node)
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _score(nodes: list[Node]) -> None:
    """Sizes of text and link text, then the points that paragraphs pass to ancestors: all, a half, a third and so on.

    Elements begin with the points of their tag and name.
    """
    for node in nodes:
        node.points = START_POINTS.get(node.tag, 0.0) + node.cost
    texts: dict[int, list[str]] = {}
    for node in nodes:  # of a block: its own, then those of its inline elements
        texts.setdefault(id(node.block), []).extend(c for c in node.children if isinstance(c, str))
    for node in reversed(nodes):
        own = [c for c in node.children if isinstance(c, str)]
        kids = [c for c in node.children if isinstance(c, Node) and not c.dropped]
        node.size = sum(len(_SPACE.sub(" ", t).strip()) for t in own) + sum(k.size for k in kids)
        node.links = node.size if node.tag == "a" else sum(k.links for k in kids)
        text = _SPACE.sub(" ", "".join(texts.get(id(node), ()))).strip()
        if text and (node.tag in PARAGRAPHS or node.tag in BLOCKS and any(t.strip() for t in own)) and node.tag not in {"h1", "h2", "h3", "h4", "h5", "h6"}:
            gained = 1 + text.count(",") + min(len(text) / 100, 3)
            above, level = node.parent if node.tag in PARAGRAPHS else node, 1
            while above is not None and level <= 5:
                above.points += gained if above.tag in WHOLE else gained / level
                above, level = above.parent, level + 1
            above = above.whole if above else None
            while above is not None:
                above.points += gained
                above = above.parent.whole if above.parent else None


def _going(nodes: list[Node]) -> list[Node]:
    """The outermost elements whose names say that they go: all, but those around the article itself.

    Such a wrapper holds an article, main or h1 element that no such name stands around below it. Where nothing else on
    the page earns a paragraph's points, all stay.
    """
    named = {id(n) for n in nodes if n.cost <= GOES}
    if not named:
        return []
    under: dict[int, Node | None] = {}  # the innermost such element around a node, itself included
    wraps: set[int] = set()
    outside = 0.0
    for node in nodes:
        above = under.get(id(node.parent)) if node.parent else None
        under[id(node)] = node if id(node) in named else above
        if node.tag in {"article", "main", "h1"} and above is not None and id(node) not in named:
            wraps.add(id(above))
    for node in nodes:
        if node.tag in PARAGRAPHS:
            inner = under[id(node)]
            if inner is None or id(inner) in wraps:
                outside += 1 + sum(c.count(",") + len(c) / 100 for c in node.children if isinstance(c, str) and c.strip())
    return [n for n in nodes if id(n) in named and id(n) not in wraps] if outside >= LEAST_OUTSIDE else []


def _value(node: Node) -> float:
    return node.points * (1 - node.links / node.size) if node.size else 0.0


def _blocks(root: Node) -> Iterator[str]:
    """The text blocks below a node, white space in each made single blanks; link lists are left out."""
    held: list[str] = []

    def flush() -> Iterator[str]:
        text = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            yield text

    stack: list[Node | str | None] = [root]
    while stack:
        item = stack.pop()
        if item is None:
            yield from flush()
        elif isinstance(item, str):
            held.append(item)
        elif item.tag == "br":
            held.append(" ")
        elif not item.dropped and not (item is not root and item.tag in {"ul", "ol", "div", "section", "table", "dl"} and item.links > 0.6 * item.size):
            edge: list[None] = [None] if item.tag in BLOCKS else []
            stack += [*edge, *reversed(item.children), *edge]
    yield from flush()


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by new lines; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    nodes = _nodes(root)
    for node in _going(nodes):
        node.dropped = True
    nodes = _nodes(root)
    for node in nodes:
        node.cost = 0.0 if node.cost <= GOES else node.cost  # the article's own wrapper
    _score(nodes)
    named = [n for n in nodes if n.cost and n.points < 0]
    if named:  # what its paragraphs don't redeem goes, with the points it gave
        for node in named:
            node.dropped = True
        nodes = _nodes(root)
        _score(nodes)
    holders = [n for n in nodes if n.tag in BLOCKS and n.tag not in PARAGRAPHS - {"td"} and n.size]
    if not holders:
        return "\n".join(_blocks(root))
    best = max(holders, key=_value)  # ties: the outermost, which comes first
    titled = any(n.tag == "h1" and _inside(n, best) for n in nodes)
    floor, chosen = max(10.0, 0.2 * _value(best)), []
    for node in best.parent.children if best.parent else [best]:
        if isinstance(node, str) or node.dropped or not node.size:
            continue
        loose = node.tag == "p" and node.links <= 0.25 * node.size and node.size >= 80 or node.tag == "h1" and not titled
        if node is best or loose or node.tag in BLOCKS and _value(node) >= floor:
            chosen.append(node)
    return "\n".join(b for node in chosen for b in _blocks(node))


def _inside(node: Node, of: Node) -> bool:
    while node is not None and node is not of:
        node = node.parent
    return node is of


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    Takes page_id, url and html; other columns are ignored. The container of the best score is the article, with those of
    its siblings that score a fifth of it, and a heading beside it; of equal scores the outermost and first. A null or empty html, and a page without any text, give an
    empty text; elements nest to any depth; null ids and urls stay; repeated rows stay. Broken and cut-off markup is read as far as it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 2, SLICE):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
