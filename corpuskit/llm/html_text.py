"""Main text of web pages by composite text density.

A page is read into a tree. What its markup names as no part of an article (menus, forms, adverts, comments and the like)
is set apart. Every other node has a density: its characters per tag, lowered by the share of them
that are links. Sums of the densities of a node's children are highest where much plain text stands side by side;
the node of the highest sum is the core, and the least density on its path to the body is the threshold at which
other parts of the page belong to the text too.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements by their behaviour in HTML (fixed values of the standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th
    thead tr ul caption""".split())
CLOSES_P = BLOCK - frozenset("body html dd dt li optgroup option legend tbody td tfoot th thead tr caption".split()) | {"li", "dd", "dt"}
# A start tag of the key ends an open element of the values, unless one of the borders stands between them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
}
# Deeper elements are read as children of the last one that fits, as browsers do; their text stays.
DEEPEST = 512

# What is no part of an article, by element, role and words of class and id.
APART = frozenset(
    """head script style textarea title xmp iframe noembed noframes noscript nav header footer aside form button select datalist
    template svg math canvas object audio video dialog menu fieldset""".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
APART_NAMES = COMMENTS | frozenset(
    """ad ads advert adverts advertisement advertisements adsense adsbygoogle adbox adslot banner promo promotion sponsor sponsored sponsors
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
    sidebar sidebars menu menus nav navbar navigation navigator breadcrumb breadcrumbs pagination pager toolbar topbar masthead header
    footer foot copyright share sharing social related recommended recommendations widget widgets skip search""".split())
CONTENT = frozenset("html body main article".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_TOLD = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_NEGATED = frozenset("no has with without non not".split())


@dataclass(eq=False, slots=True)
class Node:
    """An element; ``parts`` are its texts (str) and child elements in order."""

    tag: str
    parent: Node | None
    attributes: str = ""
    parts: list = field(default_factory=list)
    apart: bool = False
    # Without what is set apart and white space: characters of the node itself, of all in it, tags, characters in links, link tags.
    own_chars: int = 0
    chars: int = 0
    tags: int = 1
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    density_sum: float = 0.0

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if not isinstance(p, str)]


# --- from characters to a tree ------------------------------------------------------------------


class _Tree:
    def __init__(self):
        self.root = Node("#page", None)
        self.open, self.counts = [self.root], {}

    def text(self, value: str) -> None:
        if value:
            self.open[-1].parts.append(html.unescape(value))

    def _pop(self) -> None:
        self.counts[self.open.pop().tag] -= 1

    def _close_within(self, tags: set[str], borders: set[str]) -> None:
        """Ends the nearest open element of ``tags``, and what is open in it, if no border comes first; tables end all of them."""
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in borders:
                return
            if tag in tags:
                while len(self.open) > at:
                    self._pop()
                if len(tags) < 3:
                    return

    def start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P and self.counts.get("p"):
            self.end("p")
        if tag in ENDS and any(self.counts.get(t) for t in ENDS[tag][0]):
            self._close_within(*ENDS[tag])
        node = Node(tag, self.open[-1], attributes)
        self.open[-1].parts.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        """Ends an element and what is open in it; without such an open element nothing happens."""
        if self.counts.get(tag) and tag not in ("html", "body"):
            while self.open[-1].tag != tag:
                self._pop()
            self._pop()


def parse(page: str) -> Node:
    """Tree of a page of whatever quality, in time that grows with its length."""
    tree, at, pattern = _Tree(), 0, _TAG
    while True:
        start = page.find("<", at)
        if start < 0:
            tree.text(page[at:])
            return tree.root
        tree.text(page[at:start])
        follows = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2 if page.startswith(("<!-->", "<!--->"), start) else start + 4)
            at = len(page) if end < 0 else end + 3
        elif follows in ("!", "?") or follows == "/" and not page[start + 2 : start + 3].isalpha():
            end = page.find(">", start)
            at = len(page) if end < 0 else end + 1
        elif not (follows == "/" or follows.isascii() and follows.isalpha()):
            tree.text("<")
            at = start + 1
        else:
            found = pattern.match(page, start)
            if not found and pattern is _TAG:
                # A quote that never ends: from here on tags end at the next bracket, so no quote is looked for twice.
                pattern = _PLAIN_TAG
                found = pattern.match(page, start)
            if not found:  # no bracket follows any more
                return tree.root
            at = found.end()
            tag = found[2].lower()
            if found[1]:
                tree.end(tag)
                continue
            tree.start(tag, found[3])
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
                tree.text(page[at : close.start() if close else len(page)])
                at = len(page) if not close else close.start()
                if close:
                    end = page.find(">", at)
                    at = len(page) if end < 0 else end + 1
                tree.end(tag)


# --- what is set apart --------------------------------------------------------------------------


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


def _names(value: str) -> set[str]:
    """Words of a class or id; what follows words such as "no" and "has" says nothing about the element."""
    out = set()
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        out |= {w for before, w in zip(["", *words], words) if before not in _NEGATED}
    return out


def is_apart(node: Node) -> bool:
    """Whether an element's markup says that it is no part of an article."""
    if node.tag in APART:
        return True
    if not _TOLD.search(node.attributes):
        return False
    own = _attributes(node.attributes)
    if node.tag in ("html", "body"):
        return False
    if "hidden" in own or _INVISIBLE.search(own.get("style", "")) or own.get("role", "").strip().lower() in APART_ROLES:
        return True
    names = _names(f"{own.get('class', '')} {own.get('id', '')}")
    return bool(names & (COMMENTS if node.tag in CONTENT else APART_NAMES))


# --- densities ----------------------------------------------------------------------------------


def _in_order(root: Node) -> list[Node]:
    """All nodes that are not set apart, parents first, in page order."""
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        out.append(node)
        waiting += [c for c in reversed(node.children) if not c.apart]
    return out


def set_apart(root: Node) -> None:
    """Marks the elements that are no part of an article; what is in them is not looked at."""
    waiting = [root]
    while waiting:
        for child in waiting.pop().children:
            child.apart = is_apart(child)
            if not child.apart:
                waiting.append(child)


def composite_density(node: Node, body: Node) -> float:
    """Characters per tag, scaled by how little of them and of the tags are links; zeros count as one."""
    if not node.chars:
        return 0.0
    links, plain = max(1, node.link_chars), max(1, node.chars - node.link_chars)
    base = math.log(node.chars / plain * links + body.link_chars / body.chars * node.chars + math.e)
    return node.chars / node.tags * math.log(node.chars / links * node.tags / max(1, node.link_tags)) / math.log(base) if base > 1 else 0.0


def measure(body: Node) -> list[Node]:
    """Fills in the figures of all nodes below ``body`` that are not set apart, and returns these in page order."""
    nodes = _in_order(body)
    for node in reversed(nodes):
        node.own_chars = sum(len(w) for p in node.parts if isinstance(p, str) for w in p.split())
        inner = [c for c in node.children if not c.apart]
        node.chars = node.own_chars + sum(c.chars for c in inner)
        node.tags = (node.tag not in VOID) + sum(c.tags for c in inner)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, 1 + sum(c.link_tags for c in inner)
        else:
            node.link_chars, node.link_tags = sum(c.link_chars for c in inner), sum(c.link_tags for c in inner)
    for node in nodes:
        node.density = composite_density(node, body)
    for node in nodes:
        # Text that stands in the node itself counts as one more child.
        own = Node("#text", node, chars=0 if node.tag == "a" else node.own_chars, tags=1)
        node.density_sum = composite_density(own, body) + sum(c.density for c in node.children if not c.apart)
    return nodes


def _best(nodes: list[Node]) -> Node:
    """The node of the highest sum; of equal ones the first in page order."""
    return max(nodes, key=lambda n: n.density_sum)


def main_nodes(root: Node) -> list[Node]:
    """Roots of the subtrees that make up the main text, in page order."""
    set_apart(root)
    body = next((n for n in _in_order(root) if n.tag == "body"), root)
    nodes = measure(body)
    if not body.chars:
        return []
    core = _best(nodes)
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    # The whole of an element that is marked as the article belongs to the text, short lines included.
    marked = [n for n in path if n.tag in ("article", "main")]
    if marked:
        return [marked[0]]
    threshold, on_path = min(n.density for n in path), {id(n) for n in path}
    out, waiting = [], [body]
    while waiting:
        node = waiting.pop()
        if node is core:
            out.append(node)
            continue
        if id(node) not in on_path and node.density >= threshold and node.density > 0:
            out.append(node)
        else:
            waiting += reversed([c for c in node.children if not c.apart])
    return _lifted(out, core, body)


def _lifted(found: list[Node], core: Node, body: Node) -> list[Node]:
    """All of the nearest element around the parts that were found, if that is not the whole page, else these parts."""
    inside, around = {id(node) for node in found}, core
    while around is not body:
        if inside <= {id(n) for n in _in_order(around)}:
            return [around]
        around = around.parent
    return found


# --- text ---------------------------------------------------------------------------------------


def blocks_of(roots: list[Node]) -> list[str]:
    """Texts of the blocks below the nodes, white space as one space, without empty ones and what is set apart."""
    out, run = [], []

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    for root in roots:
        waiting: list = [root]
        while waiting:
            part = waiting.pop()
            if isinstance(part, str):
                run.append(part)
            elif part is None:
                flush()
            elif part.apart:
                if part.tag in BLOCK:
                    flush()
            elif part.tag == "br":
                run.append(" ")
            else:
                block = part.tag in BLOCK
                if block:
                    flush()
                    waiting.append(None)
                waiting += reversed(part.parts)
        flush()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks_of(main_nodes(parse(page)))) if page else ""


# --- the operator -------------------------------------------------------------------------------


def _main_texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(page.as_py()) for page in pages], pa.string())


def main_text_of(page: Column) -> Column:
    """Main text of whole pages; empty if there is none or the page is null."""
    # Declared nondeterministic, so that it runs once where its result is used twice.
    return F.arrow_udf(_main_texts, "string").asNondeterministic()(page.cast("string"))


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per row of ``df``: ``id``, ``url``, ``text``, ``n_chars`` (code points of the text).

    The text is that of the article in page order, a block a paragraph: no menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles, comments of readers or markup. Character references are decoded, white space within a block is one
    space, blocks are joined by an empty line. Nothing else is dropped, however long the page. A null or empty page, and one without
    text, gives an empty text. Of parts of equal density the first in the page is taken. Null and repeated ids and urls are rows
    like any other; other columns do not matter; an empty table gives no row. Pages are worked on one by one: nothing is shuffled.
    """
    found = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), main_text_of(F.col(f"`{html_col}`")).alias("text"))
    return found.select("id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
