"""Main text of web pages by composite text density.

A page becomes a tree of its elements. Each node has its characters, tags, link characters and link tags, each at least one; its
density is its characters per tag, adjusted by links: C/T times the logarithm of C/LC * T/LT to a base that grows with
the node's and the page's own share of link text. A node's density sum adds its children's densities. The core is the node with the largest
sum among those that hold blocks, so a paragraph full of inline marks is no core. The least density on the path from the core to the
body is the threshold. On that path, what is at or above the threshold stays beside the core, with headings before
it and whatever lies between blocks that stay; below the body, a node with such a second block keeps all but its link lists. What is mostly links goes.

Elements that are never article text (scripts, menus, asides, hidden ones) are cut before, since their text would count as density;
so are elements whose class, id or role names them as such, unless they hold an article or main element, or
nothing would be left. A name counts when all its words do (site-header, ad-slot; not post-header or related-work), or when one is
unmistakable (sidebar, cookie).

The operator is row-wise Python over Arrow batches: the trees are small, and no row meets another. Each step takes time in proportion to the page.

Defined cases: a null or empty html gives an empty text; unclosed and stray tags are closed or ignored as
browsers do; after a quote that never closes, tags end at the next >, and if there is none what is left is text; without a body
element the whole page is the body; a page with no text outside what is cut gives an empty text; ties of the largest sum
go to the outermost node, then the first; a very long or deep page is read whole; repeated rows give the same text each; an empty
table gives an empty result. Columns with other names are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NEVER = RAW | frozenset("head nav footer aside select button svg canvas object audio video dialog menu datalist math map".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot dd dt li legend summary figcaption".split())
#: Blocks that may be cut though not always: forms sometimes wrap a whole page.
FORM = frozenset(["form"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
IN_HEAD = frozenset("meta link title script style base noscript template".split())
#: Words in class, id or role that mark what is not the article, if all words of the name are of these or the plain ones.
JUNK = frozenset("ad ads advert adverts promo promotion promoted banner sponsor notice notices alert alerts popup modal overlay subscribe subscription signup login aside menu menus nav navigation pager toolbar topbar header footer foot copyright comment comments commentlist respond reply replies related recommended recommendations trending share sharing social widget widgets skip hidden toc search contentinfo complementary".split())
PLAIN = frozenset("site page top bottom left right list box container wrapper wrap block section area item items inner outer bar link links slot unit google col column row mobile desktop global primary secondary sticky fixed module my js is posts articles stories button buttons icon icons message text main".split())
#: Words that mark it in any name, unless the name denies it.
SURE = frozenset("advertisement advertisements advertising adsense sponsored cookie cookies consent gdpr newsletter sidebar sidenav navbar breadcrumb breadcrumbs pagination disqus masthead".split())
DENY = frozenset("has no with without not".split())
#: The name of a tag; what follows up to its end, quoted values whole; an attribute.
NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACES = re.compile(r"[\s\xa0]+")
WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
KEEP, SUSPECT, CUT = range(3)


class Node:
    __slots__ = ("tag", "fate", "kids", "parent", "holds", "blocks", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, fate: int = KEEP, parent: Node | None = None):
        self.tag, self.fate, self.kids, self.parent = tag, fate, [], parent  # kids: nodes and strings

    @property
    def nodes(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]


def _is_name_of_junk(name: str) -> bool:
    words = [w.lower() for w in WORDS.split(name) if w]
    if DENY & set(words):
        return False
    return any(w in SURE for w in words) or any(w in JUNK for w in words) and all(w in JUNK or w in PLAIN for w in words)


def _fate(tag: str, attrs: str, in_article: bool) -> int:
    if tag in NEVER or tag == "header" and not in_article:
        return CUT
    if tag in ("article", "main"):
        return KEEP
    fate = SUSPECT if tag in FORM else KEEP
    for name, a, b, c in ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return CUT
        if name in ("class", "id", "role") and any(map(_is_name_of_junk, value.split())):
            fate = SUSPECT
    return fate


class _Builder:
    """The open elements, with what is needed to close them in constant time."""

    def __init__(self):
        self.root = Node("body")
        self.stack = [self.root]
        self.at: dict[str, list[int]] = {}  # places of each open tag
        self.blocks = [0]  # places of open blocks

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK or node.tag in NEVER:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut_to(self, place: int) -> None:
        while len(self.stack) > max(1, place):
            node = self.stack.pop()
            self.at[node.tag].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """The last open element of that tag; an inline end does not reach beyond a block."""
        places = self.at.get(tag)
        if places and (tag in BLOCK or tag in NEVER or places[-1] > self.blocks[-1]):
            self.cut_to(places[-1])

    def open(self, tag: str, attrs: str) -> None:
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.cut_to(len(self.stack) - 1)
        if tag in BLOCK:
            self.cut_to(self.blocks[-1] + 1)  # inline elements left open
            if tag in CLOSES_P and self.stack[-1].tag == "p":
                self.cut_to(len(self.stack) - 1)
            same = SAME.get(tag, ())
            while same and len(self.stack) > 1 and self.stack[-1].tag in (*same, "p"):
                self.cut_to(len(self.stack) - 1)
        in_article = bool(self.at.get("article") or self.at.get("main"))
        node = Node(tag, _fate(tag, attrs, in_article), self.stack[-1])
        self.stack[-1].kids.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            self.push(node)


def parse(page: str) -> Node:
    """The body as a tree of nodes and decoded texts."""
    b, at, quotes = _Builder(), 0, True
    low = page.lower() if "<" in page else ""
    if len(low) != len(page):  # a letter whose lower case is longer
        low = "".join(c.lower() if c.isascii() else c for c in page)

    def text(x: str) -> None:
        if x:
            b.stack[-1].kids.append(html.unescape(x))

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            break
        text(page[at:start])
        at = start
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        m = NAME.match(page, start)
        if not m and page[start + 1:start + 2] not in ("!", "?"):
            text("<")
            at = start + 1
            continue
        close = REST.match(page, m.end()) if m and quotes else None
        end = close.end() if close else page.find(">", start) + 1
        quotes = quotes and (not m or close is not None)
        if not end:
            break  # no tag ends any more
        at = end
        if not m:
            continue
        tag, attrs = m[2].lower(), page[m.end():end - 1]
        if tag in ("html", "body"):
            if tag == "body" and b.at.get("head"):
                b.cut_to(b.at["head"][0])
        elif m[1]:
            b.close(tag)
        elif tag in RAW:  # its text is not markup
            end = low.find(f"</{tag}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(page)
        else:
            b.open(tag, attrs)
    text(page[at:])
    return b.root


def _from_leaves(root: Node) -> list[Node]:
    """All nodes, children before parents."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(n.nodes)
    return order[::-1]


def _length(x: str) -> int:
    return len(SPACES.sub(" ", x).strip())


def _cut(root: Node) -> None:
    """Take out what is never article text, and suspects that hold no article unless nothing else has text."""
    for n in (nodes := _from_leaves(root)):
        n.kids = [k for k in n.kids if isinstance(k, str) or k.fate != CUT]
        n.holds = n.tag in ("article", "main") or any(k.holds for k in n.nodes)
    for n in nodes:
        rest = [k for k in n.kids if isinstance(k, str) or k.fate == KEEP or k.holds]
        n.chars = sum(_length(k) if isinstance(k, str) else k.chars for k in rest)
    if root.chars:
        for n in nodes:
            n.kids = [k for k in n.kids if isinstance(k, str) or k.fate == KEEP or k.holds]


def _measure(root: Node) -> None:
    """Characters, tags, densities and sums of all nodes."""
    order = _from_leaves(root)
    for n in order:
        kids = n.nodes
        n.chars = sum(k.chars for k in kids) + sum(_length(k) for k in n.kids if isinstance(k, str))
        n.tags = sum(k.tags + 1 for k in kids)
        n.link_chars = n.chars if n.tag == "a" else sum(k.link_chars for k in kids)
        n.link_tags = sum(k.link_tags + (k.tag == "a") for k in kids)
        n.blocks = any(k.tag in BLOCK for k in kids)
    share = root.link_chars / max(1, root.chars)
    for n in order:
        c, t, lc, lt = max(1, n.chars), max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(c / max(1, c - n.link_chars) * lc + share * c + math.e)
        n.density = c / t * max(0.0, math.log(c / lc * t / lt)) / math.log(base) if n.chars else 0.0
        n.sum = sum(k.density for k in n.nodes)


def _select(root: Node) -> None:
    """Leave the core and what belongs to it, by the threshold of its path."""
    core, todo = root, [root]
    while todo:
        n = todo.pop()
        if n.blocks and n.sum > core.sum:
            core = n
        todo.extend(n.nodes[::-1])
    path = [core]
    while path[-1] is not root:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    heavy = lambda k: not isinstance(k, str) and 2 * k.link_chars > k.chars
    if core is root:
        light = [k for k in root.kids if not heavy(k)]
        root.kids = light if any(isinstance(k, str) and k.strip() or not isinstance(k, str) and k.chars for k in light) else root.kids
    for child, n in zip(path, path[1:]):
        at = next(i for i, k in enumerate(n.kids) if k is child)
        good = {i for i, k in enumerate(n.kids) if k is child or not isinstance(k, str) and k.chars and not heavy(k) and k.density >= threshold}
        if len(good) > 1 and n is not root:
            good = set(range(len(n.kids)))
        first, last = min(good), max(good)
        n.kids = [k for i, k in enumerate(n.kids) if i in good and not (heavy(k) and k is not child) or not heavy(k) and (first < i < last or not isinstance(k, str) and k.tag in HEADINGS and i < at)]


def _texts(n: Node, out: list[list[str]]) -> None:
    """Add the node's text, block by block; the last list is the open block."""
    todo: list = [(n, 0)]
    while todo:
        n, k = todo.pop()
        if k == 0 and n.tag in BLOCK:
            out.append([])
        if k < len(n.kids):
            todo.append((n, k + 1))
            kid = n.kids[k]
            if isinstance(kid, Node):
                if kid.tag == "br":
                    out[-1].append(" ")
                todo.append((kid, 0))
            else:
                out[-1].append(kid)
        elif n.tag in BLOCK:
            out.append([])


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _cut(root)
    _measure(root)
    if not root.chars:
        return ""
    _select(root)
    out: list[list[str]] = [[]]
    _texts(root, out)
    blocks = (SPACES.sub(" ", "".join(b)).strip() for b in out)
    return "\n".join(b for b in blocks if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
