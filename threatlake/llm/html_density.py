"""Main text of web pages by composite text density.

For every node of a page's tree the density is its characters per tag, weighed down by the share of links among them:
with C characters and T tags below a node, LC and LT of them in links, and the same for the body (LCb, Cb), it is

    C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LCb / Cb * C + e))      (0 in a denominator counts as 1)

A node's density sum adds the densities of its children. The subtree with the largest sum holds the article. The least density
on its path to the body is the threshold: wherever a node reaches it, the subtree with the largest sum below it
belongs to the article too, as does an ``article`` or ``main`` element around the first. Elements that are never part of an article (navigation, forms, asides, notices,
reader comments and such, by element, role, class or id) are taken out before. Class and id alone, ``form`` and ``noscript`` never take out an element
that holds an ``article`` or ``main`` or most of the page's text outside links, as where a whole page stands in one form: there the density
decides, and only controls and their labels go. The words that mark such parts are English.

Pages are independent: one narrow pass, no shuffle.

Of subtrees with equal sums the first on the page is taken.

Defined cases: a null, empty or mark-up-only page has the empty text; unclosed and crossed elements are closed where their
parents end; an unclosed comment, script or tag runs to the end; rows that repeat a page are all returned; other columns are
ignored; no pages give no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PART = re.compile(r"[a-z]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr del img".split()
)
#: Start tags that close an open element of the same kind, up to the given parents.
SELF_CLOSING = {
    "p": set("article section div body main blockquote li td th dd button".split()), "li": {"ul", "ol", "menu"},
    "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"},
    "option": {"select", "datalist"},
}
#: Start tags that close an open paragraph.
BLOCKS = set(
    "address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split()
)
#: Elements that are no part of an article.
APART = set(
    "head nav footer aside script style template iframe object embed svg canvas button select textarea input label legend "
    "menu dialog title xmp noembed noframes audio video math".split()
)
#: Elements that are none either, unless they hold it.
PERHAPS_APART = {"form", "noscript"}
APART_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark such parts.
APART_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer discussion disqus footer header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promos promotion recommended related replies respond share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words that may stand beside those in a name; with any other ('no-sidebar', 'post-share') it says something else.
BESIDE = set(
    "area bar block body bottom box btn button buttons container content first float group inner item items last left links list outer posts "
    "primary right row second secondary section site slot small sticky top unit wrap wrapper".split()
)
KEPT = set("html body article main h1".split())


class Node:
    __slots__ = ("tag", "parent", "children", "apart", "named", "title", "chars", "tags", "link_chars", "link_tags", "density", "total", "chosen")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.apart = self.named = self.title = self.chosen = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_apart(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in APART or (tag == "header" and not inside_article):
        return True
    if not attributes or tag in KEPT:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in APART_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _is_named_apart(attributes: str) -> bool:
    """Whether a class or id marks such a part."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for token in "".join(values).lower().split():
                parts = set(_PART.findall(token))
                if not APART_WORDS.isdisjoint(parts) and parts <= APART_WORDS | BESIDE:
                    return True
    return False


def parse(page: str) -> Node:
    """The tree of a page below a root; leaves of ``children`` are strings."""
    root = Node("body", None)
    node, at, end = root, 0, len(page)
    opened: dict[str, int] = {}  # open elements by tag

    def say(text: str) -> None:
        if text:
            node.children.append(html.unescape(text) if "&" in text else text)

    def leave(last: Node) -> None:
        """Close ``last`` and all that is open in it."""
        nonlocal node
        up = last.parent
        while node is not up:
            opened[node.tag] -= 1
            node = node.parent

    while at < end:
        found = _MARKUP.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            if opened.get(tag):  # an end tag without its start costs nothing, however deep it stands
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up)
            continue
        if tag in ("html", "body"):
            continue
        scope = SELF_CLOSING.get("p" if tag in BLOCKS else tag)
        kind = "p" if tag in BLOCKS else tag
        if scope and opened.get(kind):
            up = node
            while up is not root and up.tag != kind and up.tag not in scope:
                up = up.parent
            if up.tag == kind and up is not root:
                leave(up)
        attributes = found[3] or found[6] or ""
        child = Node(tag, node)
        child.apart = _is_apart(tag, attributes, bool(opened.get("article") or opened.get("main")))
        child.named = not child.apart and (tag in PERHAPS_APART or bool(attributes) and _is_named_apart(attributes))
        node.children.append(child)
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = close.start() if close else end
            node = child
            opened[tag] = opened.get(tag, 0) + 1
            if not close:
                break
        elif tag not in VOID and not attributes.endswith("/"):
            node = child
            opened[tag] = opened.get(tag, 0) + 1
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes, each before its children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _prune(root: Node) -> None:
    nodes = _nodes(root)
    linked: dict[int, bool] = {}  # in a link or an element that leaves anyway
    for node in nodes:
        linked[id(node)] = node.apart or node.tag == "a" or (node.parent is not None and linked[id(node.parent)])
    plain: dict[int, int] = {}
    body: dict[int, bool] = {}
    for node in reversed(nodes):
        inside = [c for c in node.children if isinstance(c, Node)]
        own = 0 if linked[id(node)] else sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        plain[id(node)] = own + sum(plain[id(c)] for c in inside)
        # an element named as a comment or such is no article, whatever its tag
        body[id(node)] = not node.apart and (node.tag in ("article", "main") and not node.named or any(body[id(c)] for c in inside))
    for node in nodes:
        if node.named and node.tag not in KEPT and not body[id(node)] and 2 * plain[id(node)] <= plain[id(root)]:
            node.apart = True
    for node in reversed(nodes):
        if node.tag == "h1" and not node.apart or any(isinstance(c, Node) and c.title for c in node.children):
            node.title = node.tag not in APART
    for node in nodes:  # an element with the title in it is no mere header or banner
        node.children = [c for c in node.children if not isinstance(c, Node) or not c.apart or c.title and c.tag not in APART]


def _measure(root: Node) -> list[Node]:
    nodes = _nodes(root)
    for node in reversed(nodes):
        link = node.tag == "a"
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
            else:
                node.chars += len(" ".join(c.split()))
        if link:
            node.link_chars = node.chars
    share = root.link_chars / max(1, root.chars)
    for node in reversed(nodes):
        if node.chars:
            c, lc, t, lt = node.chars, node.link_chars, max(1, node.tags), max(1, node.link_tags)
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            ratio = c / max(1, lc) * t / lt
            # without a link on the page the base is 1: then the logarithm alone weighs
            node.density = c / t * math.log(max(1.0, ratio)) / (math.log(base) if base > 1 + 1e-9 else 1.0)
        own = [c.density for c in node.children if isinstance(c, Node) and c.tag not in INLINE and c.tag not in VOID]
        node.total = sum(own) if own else node.density
    return nodes


def _choose(root: Node, nodes: list[Node]) -> None:
    blocks = [n for n in nodes if n.tag not in INLINE and n.tag not in VOID]
    best = max(blocks, key=lambda n: n.total)
    threshold, up = best.density, best
    while up is not None:
        threshold, up = min(threshold, up.density), up.parent
    largest: dict[int, Node] = {}
    for node in reversed(blocks):  # of each subtree the node with the largest sum
        top = largest.get(id(node), node)
        top = largest[id(node)] = node if node.total >= top.total else top
        up = node.parent
        while up is not None and up.tag in INLINE:
            up = up.parent
        if up is not None and (id(up) not in largest or top.total >= largest[id(up)].total):
            largest[id(up)] = top
    for node in blocks:
        if node.chars and node.density >= threshold:
            largest[id(node)].chosen = True
    # an element that calls itself the article is taken whole; elsewhere the heading before the text joins it
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        up.chosen = True
    else:
        before = [n for n in nodes[: nodes.index(best)] if n.tag == "h1"]
        if before and not any(n.tag == "h1" for n in _nodes(best)):
            before[-1].chosen = True


def _blocks(root: Node) -> list[str]:
    blocks, parts = [], []

    def end_block() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append(text)

    stack: list = [(root, root.chosen)]
    while stack:
        item, chosen = stack.pop()
        if item is None:
            end_block()
        elif isinstance(item, str):
            if chosen:
                parts.append(item)
        else:
            if item.tag not in INLINE:
                end_block()
                stack.append((None, False))
            stack += [(c, chosen or isinstance(c, Node) and c.chosen) for c in reversed(item.children)]
    end_block()
    return blocks


def main_text(page: str | None) -> str:
    root = parse(page or "")
    _prune(root)
    nodes = _measure(root)
    if not root.chars:
        return ""
    _choose(root, nodes)
    return " ".join(_blocks(root))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
