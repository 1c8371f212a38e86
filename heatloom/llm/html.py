"""Main text of web pages by composite text density.

A page becomes a tree of elements. For each node the characters, tags, link characters and link tags below it give its
composite density: characters per tag, scaled down by the share that stands in links. Each node's density sum is the
sum over its children; the node with the largest sum is the core of the article. The least density on the way from the
core up to the body is the threshold: siblings of that way that reach it belong to the text too.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
         "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
         "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
         "td", "tfoot", "th", "thead", "tr", "ul"}
DROPPED = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "form", "button", "select",
           "textarea", "input", "nav", "menu", "aside", "footer", "dialog", "title", "noembed", "noframes", "xmp", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Words of class and id names that mark what is not the article.
NOISE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "breadcrumb", "breadcrumbs",
         "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu",
         "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo",
         "promoted", "promotion", "recommended", "related", "replies", "respond", "rail", "share", "sharing", "sidebar", "signup",
         "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar", "topbar", "widget"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"html", "body", "table", "td", "th", "ul", "ol", "dl", "article", "main", "section", "div", "aside", "nav", "blockquote", "form", "header", "footer"}

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[!?/][^>]*>)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: What stands in a head; any other element and any text ends it.
HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: Of the words in NOISE those of what readers write, which can be longer than the article.
REPLIES = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("name", "parent", "parts", "noise", "words", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, noise: bool = False, words: set[str] = frozenset()):
        self.name, self.parent, self.noise = name, parent, noise
        self.words = words  # class and id words that may mark noise
        self.parts: list = []  # child nodes and strings, in page order
        self.clear()

    def clear(self) -> None:
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    @property
    def plain(self) -> int:
        return self.chars - self.link_chars


def _marks(name: str, attributes: str) -> tuple[bool, set[str]]:
    """Whether an element is noise by its name, role or hiddenness, and its class and id words that may mark noise."""
    words: set[str] = set()
    if name in DROPPED:
        return True, words
    if not attributes or name in ("body", "html", "main"):
        return False, words
    noise = NOISE if name != "article" else {"comment", "comments", "teaser"}
    for key, value in _ATTR.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, words
        if key == "role":
            if value.lower() in ROLES:
                return True, words
        elif key in ("class", "id"):
            words |= noise.intersection([w.lower() for w in _NAME.findall(value)] + re.split("[^a-z]+", value.lower()))
    return False, words


def parse(page: str) -> Node:
    """The tree of a page; unclosed and crossing tags are mended as browsers do in the common cases."""
    root = Node("html", None)
    here, at, end = root, 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = end if m is None else m.start()
        if here.name == "head" and page[at:stop].strip():
            here = here.parent
        if stop > at:
            here.parts.append(page[at:stop])
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            node = here
            while node is not None and node.name != name:
                if name not in BLOCK and node.name in SCOPE:
                    node = None  # an inline end tag does not close a block around it
                    break
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if here.name == "head" and name not in HEAD and name != "html":
            here = here.parent
        if name in ("html", "body"):
            continue
        if name in BLOCK:
            here = _close(here, {"p"})
        if name in CLOSED_BY:
            here = _close(here, CLOSED_BY[name])
        noise, words = _marks(name, m[3])
        node = Node(name, here, noise or name == "header" and not _inside(here, "article", "main"), words)
        here.parts.append(node)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            at = end if stop is None else stop.start()
            if stop is not None:
                at = page.find(">", at) + 1 or end
        elif name not in VOID and not m[3].endswith("/"):
            here = node
        elif name not in VOID:
            here = node if name in BLOCK else here
    return root


def _close(here: Node, names: set[str]) -> Node:
    """The node after closing the nearest open element of these names in scope."""
    node = here
    while node is not None:
        if node.name in names:
            return node.parent or node
        if node.name in SCOPE and node.name not in names:
            return here
        node = node.parent
    return here


def _inside(node: Node | None, *names: str) -> bool:
    while node is not None:
        if node.name in names:
            return True
        node = node.parent
    return False


def _measure(root: Node) -> list[Node]:
    """Counts of every node that is not noise, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.parts = [p for p in node.parts if isinstance(p, str) or not p.noise]
        stack += [p for p in node.parts if not isinstance(p, str)]
    order.reverse()
    for node in order:
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(part) - part.count(" ") if part.strip() else 0
            else:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.name == "a")
        if node.name == "a":
            node.link_chars = node.chars
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        if node.chars:
            plain = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            ratio = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1)
            node.density = node.chars / max(node.tags, 1) * math.log(max(ratio, 1e-9)) / math.log(base) if base > 1 else 0.0
        node.total = sum(p.density for p in node.parts if not isinstance(p, str))
    return order


def _core(order: list[Node]) -> Node:
    core, best = order[-1], -math.inf
    for node in order:  # children first, so the innermost of equals wins
        if node.total > best and node.chars:
            core, best = node, node.total
    return core


def _judge_words(order: list[Node]) -> None:
    """Makes noise of the nodes with such class or id words, but not of one that holds the core or half of the plain text.

    A node without an article or main element is noise all the same when there is one with text outside it, and so is
    one named after replies unless it has ten times the plain text of the rest.
    """
    root, way, node = order[-1], set(), _core(order)
    while node is not None and (way or node.total > 0):  # without links all densities are zero and only the share tells
        way.add(node)
        node = node.parent
    bodies = [n for n in order if n.name in ("article", "main") and n.plain and not n.words]
    above = [set(_ancestors(n)) for n in bodies]
    for node in order:
        if node.words:
            holds = any(node in up for up in above)
            spared = node in way or 2 * node.plain >= max(root.plain, 1)
            if bodies and not holds or not holds and node.words & REPLIES and node.plain < 10 * (root.plain - node.plain):
                spared = False
            node.noise = not spared and not (holds and all(node in up for up in above))


def _ancestors(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def _article(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    order = _measure(root)
    if any(node.words for node in order):
        _judge_words(order)
        for node in order:
            node.clear()
        order = _measure(root)
    core = _core(order)
    whole = core
    node = core
    while node is not None:
        if node.name in ("article", "main"):
            whole = node
        node = node.parent
    if whole.name in ("article", "main"):
        return [whole]
    way, node = [], core
    while node is not None:
        way.append(node)
        node = node.parent
    threshold = min(n.density for n in way)
    chosen = core
    for node in way[1:]:
        if any(not isinstance(p, str) and p not in way and p.chars and p.density >= threshold for p in node.parts):
            chosen = node
    if chosen is core:
        return [core]
    return [chosen]


def _blocks(nodes: list[Node]) -> list[str]:
    out, run = [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    for top in nodes:
        stack: list = [top]
        while stack:
            part = stack.pop()
            if part is None:
                flush()
            elif isinstance(part, str):
                run.append(part)
            elif part.name == "br":
                run.append(" ")
            elif part.name in BLOCK:
                flush()
                stack.append(None)
                stack += reversed(part.parts)
            else:
                stack += reversed(part.parts)
        flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order joined by a line feed, white space inside a block as one blank."""
    if not page:
        return ""
    root = parse(page)
    return "\n".join(_blocks(_article(root)))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = max(1, int(4_000_000 * max(1, batch.num_rows) // max(1, batch.nbytes)))
        for lo in range(0, batch.num_rows, size):
            part = batch.slice(lo, size)
            texts = [main_text(page) for page in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id, url, ``text`` and ``n_chars`` (code points of the text).

    A null or empty page, and one without an article, has the empty text. Nothing is cut: a page of any length is
    read whole. Repeated rows give repeated results; other columns are not returned.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(_run, f"id {kinds['id']}, url {kinds['url']}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
