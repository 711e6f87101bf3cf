"""Main text of web pages by composite text density.

The page becomes a tree (a lenient reader closes what HTML lets one leave
open). For every node the density is its characters per tag, adjusted by the
characters and tags of its links: C/T * log_b((C/LC) * (T/LT)) with
b = ln(C/nonLC * LC + LC_body/C_body * C + e). A node's density sum adds the
densities of its children. The node of greatest sum is the content's centre,
and the least density on its path to the body is the threshold: beside the path
each highest node whose density reaches it is kept, with headings right before
it. The centre itself is widened to the highest node above it whose density
stays near its own, so that an article in several parts is kept whole. Elements that are no article whatever their density
(scripts, styles, menus, headers of the page, footers, sidebars by tag or ARIA
role, hidden ones) are not read at all.

Names come after densities. A class or id that names a menu, notice, advert,
comment or the like is a hint, and so is a form: within what the densities
choose such an element is left out, unless it encloses the centre. Where a hint
encloses the centre although an article or main element beside it has text
(comments longer than the article), it is left out and the densities are taken
anew. A form around the centre loses its controls and labels only. A class
hints by its whole name, or if all its parts are hints (cookie-notice, but not
has-sidebar).

Text is decoded, white space inside a block becomes one blank, blocks are
trimmed and joined in page order by one blank.

Defined results: null html counts as empty; a page without text gives the empty
text; broken markup is read as far as it goes; repeated rows give repeated
rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("script style noscript template head nav footer aside button select textarea iframe object svg canvas dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
HINT_ROLES = frozenset({"form"})
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside widget related share sharing social cookie cookies consent notice popup modal newsletter subscribe comment comments respond disqus login search pagination pager".split())
#: Opening one of these ends an open element of the set beside it, up to the stop elements.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "children", "parent", "out", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "flat", "own", "hint")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, hint: bool = False):
        self.hint = hint
        self.tag, self.parent, self.out, self.children = tag, parent, out, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.flat, self.own = False, [0, 0, 0]
        self.best = self


class _Reader(HTMLParser):
    """Builds the tree; ``where`` holds the places of open tags on the stack, so that no tag walks up the tree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("body", None)
        self.stack, self.where = [self.root], {}

    def _top(self, names) -> int:
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def _close(self, names, stops=frozenset()):
        """Close the innermost open element of ``names``, unless one of ``stops`` is inside it."""
        at = self._top(names)
        if at and at > self._top(stops):
            for node in self.stack[at:]:
                self.where[node.tag].pop()
            del self.stack[at:]

    def _within(self, *tags: str) -> bool:
        return any(self.where.get(tag) for tag in tags)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            self._close({"head"})  # its end may be missing
            return
        if tag in _ENDS_P:
            self._close({"p"}, {"table", "td", "th", "button", "caption"})
        if tag in _SIBLINGS:
            for _ in range(2):
                self._close(*_SIBLINGS[tag])
        out = tag in LEFT_OUT or tag == "header" and not self._within("article", "main", "section") or any(_unseen(k, v) for k, v in attrs)
        hint = tag == "form" or tag == "label" and self._within("form") or any(_hinted(k, v) for k, v in attrs if v)
        node = Node(tag, self.stack[-1], out, hint)
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.where.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        depth = len(self.stack)
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.stack) >= depth and self.stack[-1].tag == tag and len(self.stack) > 1:
            self.where[tag].pop()
            self.stack.pop()

    def handle_endtag(self, tag):
        if tag not in ("html", "body"):
            self._close({tag})

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _unseen(name: str, value: str | None) -> bool:
    """Hidden, or a part of the page that its ARIA role tells apart."""
    return name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true" or name == "role" and (value or "").lower() in ROLES


def _hinted(name: str, value: str) -> bool:
    if name in ("class", "id"):
        return any(all(part in HINTS for part in _PARTS.split(token) if part) for token in value.lower().split() if _PARTS.sub("", token))
    return name == "role" and value.lower() in HINT_ROLES


def read_page(html: str) -> Node:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root


def _walk(root: Node) -> list[Node]:
    """Elements that are not left out, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.out)
    return out


def measure(root: Node) -> None:
    """Counts, densities and density sums of every node, children before parents.

    Inline elements without blocks inside do not count as tags, but links do. A
    node's text outside its blocks counts as one child without tags.
    """
    nodes = _walk(root)
    for node in reversed(nodes):
        own = [0, 0, 0]
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.flat = node.tag in INLINE
        for child in node.children:
            if isinstance(child, str):
                own[0] += len(_SPACE.sub(" ", child).strip())
            elif not child.out:
                node.chars += child.chars
                node.tags += child.tags + (child.tag == "a" or not child.flat and child.tag not in VOID)
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
                if child.flat:
                    own = [own[0] + child.chars, own[1] + child.link_chars, own[2] + child.link_tags]
                elif child.tag not in VOID:
                    node.flat = False
        node.chars += sum(len(_SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        node.own = own
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in reversed(nodes):
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        inner = [child for child in node.children if isinstance(child, Node) and not child.out and not child.flat]
        node.total = sum((child.density for child in inner), _density(node.own[0], node.own[2], node.own[1], node.own[2], share))
        node.best = max([node, *(child.best for child in inner)], key=lambda n: n.total)


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, scaled down as links take more of the characters and tags."""
    if not chars:
        return 0.0
    base = chars / max(1, chars - link_chars) * link_chars + share * chars + math.e
    links = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return chars / max(1, tags) * max(0.0, math.log(links)) / math.log(base)


def _path(node: Node) -> list[Node]:
    """The node and what encloses it."""
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def _misled(root: Node) -> list[Node]:
    """Hinted elements around the centre that leave text of an article or main element beside them."""
    path = _path(root.best)
    if not any(node.hint and node.tag != "form" for node in path):
        return []
    on_path, under = set(path), {root: False}
    nodes, inside = _walk(root), {}
    for node in nodes[1:]:
        under[node] = under[node.parent] or node.hint and node not in on_path
    for node in reversed(nodes):  # articles with text in each subtree
        own = node.tag in ("article", "main") and node not in on_path and node.chars > 0 and not under[node]
        inside[node] = own + sum(inside[c] for c in node.children if isinstance(c, Node) and not c.out)
    return [node for node in path if node.hint and node.tag != "form" and inside[node] < inside[root]]


#: Least density of a node above the centre, as a share of the centre's, that still belongs to the article.
WIDEN = 0.5
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _dense(root: Node) -> list[Node]:
    """The subtrees that the densities choose, in page order.

    The centre is widened to the highest node above it, below the body, whose
    density and those between stay near the centre's: parts, leads and titles of
    one article. Blocks beside the centre in there that are mostly links are out.
    """
    centre = root.best
    if centre is root:
        return [root]
    path = _path(centre)[:-1]
    threshold = min(node.density for node in path)
    high = 0
    while high + 1 < len(path) and path[high + 1].density >= WIDEN * centre.density:
        high += 1
    on_path, top = set(path), path[high]
    for node in path[1 : high + 1]:
        for c in node.children:
            if isinstance(c, Node) and not c.flat and c not in on_path and 2 * c.link_chars > c.chars:
                c.out = True
    found, todo, titles = [], [root], set()
    while todo:
        node = todo.pop()
        if node is top or node in titles or node not in on_path and node is not root and node.chars and node.density >= threshold:
            found.append(node)
            continue
        blocks = [c for c in node.children if isinstance(c, Node) and not c.out and not c.flat]
        before_kept = False
        for c in reversed(blocks):  # headings right before what is kept
            if c is top or c in on_path and node is not root or c not in on_path and c.chars and c.density >= threshold:
                before_kept = True
            elif c.tag in _HEADINGS and before_kept:
                titles.add(c)
            elif c.chars:
                before_kept = False
        todo.extend(reversed(blocks))
    return found


def content(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    measure(root)
    while misled := _misled(root):
        for node in misled:
            node.out = True
        measure(root)
    found, around = _dense(root), set(_path(root.best))
    for top in found:
        for node in _walk(top):
            node.out = node.hint and node not in around
    return [node for node in found if not node.out]


def text_of_nodes(nodes: list[Node]) -> str:
    """Blocks of the subtrees, white space inside a block made one blank, joined by one blank."""
    blocks: list[list[str]] = [[]]

    def take(node: Node) -> None:
        todo: list = [node]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                blocks[-1].append(item)
            elif item is None:
                blocks.append([])
            elif item.tag == "br":
                blocks[-1].append(" ")
            elif not item.out:
                block = item.tag not in INLINE
                if block:
                    blocks.append([])
                    todo.append(None)
                todo.extend(reversed(item.children))

    for node in nodes:
        blocks.append([])
        take(node)
    texts = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return " ".join(t for t in texts if t)


def main_text(html: str) -> str:
    return text_of_nodes(content(read_page(html)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            texts = [main_text(h.as_py()) for h in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
