"""Main text of web pages by composite text density.

A tolerant parser builds the tree of elements. Parts that say what they are (navigation, footers,
forms, scripts, adverts, comments and so on, by element, role, or a class or id made of such words) leave
the tree. For every node, text density is characters per tag, lowered where link characters and link tags
abound; a node's sum is that of its children's densities. The subtree of the node with the largest sum is
the main text. The least density on the path from that node to the body is the threshold: the choice grows
to its parent while a neighbour reaches the threshold or nothing else is in the parent.

Edge cases: null, empty and non-HTML input gives what text it holds, or an empty string; unclosed and
stray tags, broken attributes and truncated pages are read as browsers read them, nearly; repeated
rows are read alike. Texts are processed whole. Extra columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
ATTR = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
CELLS = {"td", "th", "table"}
#: An element that opens ends these, up to the nearest element of the second set.
_P = frozenset({"p"})
_SCOPE = frozenset({"table", "td", "th", "caption", "button", "html", "body", "object", "article", "section", "div", "li", "blockquote", "dd"})
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir", "table", "td", "body", "article", "section", "nav"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "body", "article"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "body", "article"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table", "body"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table", "body"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table", "body"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup", "body"})),
}
DROP = set(
    "head nav footer aside form script style noscript template iframe svg button select textarea input dialog menu object embed "
    "canvas audio video title xmp noembed noframes datalist search".split()
)
#: Elements whose text is running text; a button in it is a word of it.
RUNNING = {"p", "li", "td", "dd", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words that name parts that aren't main text.
DROP_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social comment comments disqus respond reply replies related recommended "
    "recommendations widget toolbar pagination pager skip masthead copyright disclaimer".split()
)
#: Words that may stand beside them in one name. A name with any other word ("social-history") names something else.
BESIDE = set(
    "site page global main top bottom left right upper lower primary secondary box list items item wrap wrapper container content block area "
    "section region bar links link inner outer unit slot panel group row col column header head title text body icon icons button buttons form "
    "post posts article articles entry entries story stories news media bottom sticky fixed floating mobile desktop js the id class div".split()
)
HEADER_WORDS = {"header", "topbar", "masthead"}
SAFE = {"html", "body", "article", "main"}


class Node:
    __slots__ = ("tag", "parent", "kids", "drop", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, drop: int = 0):
        self.tag, self.parent, self.kids, self.drop = tag, parent, [], drop


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _dropped(tag: str, attrs: str) -> int:
    """0: stays; 1: goes; 2: goes unless within or around an article."""
    if tag in DROP:
        return 1
    if tag in SAFE:
        return 0
    kind = 2 if tag == "header" else 0
    if attrs and not attrs.isspace():
        a = _attributes(attrs)
        if "hidden" in a or a.get("role", "").lower() in DROP_ROLES or "display:none" in a.get("style", "").replace(" ", "").lower():
            return 1
        for name in (a.get("class", "") + " " + a.get("id", "")).split():
            words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if len(w) > 1}
            if words & DROP_WORDS and words <= DROP_WORDS | BESIDE:
                return 3
            if words & HEADER_WORDS and words <= HEADER_WORDS | BESIDE:
                kind = 2
    return kind


class _Open:
    """The open elements: a path from the root, and for each tag its open ones, so an end tag or an element that
    closes others looks at a few depths and not along the path."""

    def __init__(self, root: Node):
        self.path, self.by_tag, self.blocks, self.cells = [root], {}, [], []

    def deepest(self, tags) -> int:
        """Depth of the innermost open element of these tags, 0 if there is none."""
        return max((self.by_tag[t][-1] for t in tags if self.by_tag.get(t)), default=0)

    def push(self, node: Node) -> None:
        depth = len(self.path)
        self.path.append(node)
        self.by_tag.setdefault(node.tag, []).append(depth)
        for kind, tags in ((self.blocks, BLOCK), (self.cells, CELLS)):
            if node.tag in tags:
                kind.append(depth)

    def close(self, depth: int) -> None:
        """Close the element at this depth and all in it."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.by_tag[tag].pop()
            for kind, tags in ((self.blocks, BLOCK), (self.cells, CELLS)):
                if tag in tags:
                    kind.pop()

    def end(self, tag: str) -> None:
        """An end tag: closes the innermost such element, but not across a block (inline tags) or cell (p, li)."""
        depth = self.deepest((tag,))
        wall = self.cells if tag in ("p", "li") else self.blocks if tag not in BLOCK else []
        if depth and not (wall and wall[-1] > depth):
            self.close(depth)


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all elements in order; texts are strings among a node's kids. Time grows with the page's
    length alone: no tag is looked for behind the last ">"."""
    root = Node("#root", None)
    nodes, open_, at, n = [root], _Open(root), 0, len(page)
    last = page.rfind(">") + 1
    while at < n:
        m = TOKEN.search(page, at) if at < last or page.find("<!", at) >= 0 or page.find("<?", at) >= 0 else None
        if m is None:
            tail = page[at:]
            cut = re.search(r"<[a-zA-Z/!?][^<>]*\Z", tail)  # a tag that the page's end cuts off
            open_.path[-1].kids.append(tail[: cut.start()] if cut else tail)
            break
        if m.start() > at:
            open_.path[-1].kids.append(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            if m.group().startswith("<![CDATA["):
                open_.path[-1].kids.append(m.group()[9:].removesuffix("]]>"))
            continue
        tag, ending = name.lower(), m["end"] or m["end2"]
        if ending:
            if tag == "br":
                open_.path[-1].kids.append(" ")
            else:
                open_.end(tag)
            continue
        if tag in ("html", "body") and any(k.tag == tag for k in nodes[1:4]):
            continue
        if tag in ENDS or tag in BLOCK:
            close, scope = ENDS.get(tag, (_P, _SCOPE))
            depth = open_.deepest(close)
            if depth > open_.deepest(scope - close):
                open_.close(depth)
                if tag == "tr" and open_.path[-1].tag == "tr":
                    open_.close(len(open_.path) - 1)
        if tag == "body" and open_.path[-1].tag == "head":
            open_.close(len(open_.path) - 1)
        top = open_.path[-1]
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        if tag == "br":
            top.kids.append(" ")
        node = Node(tag, top, _dropped(tag, attrs))
        top.kids.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, last)
            node.kids.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not attrs.rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            open_.push(node)
    return root, nodes


def prune(nodes: list[Node]) -> None:
    """Mark what isn't main text with drop = 1, the rest with 0."""
    around = set()
    for x in nodes:
        if x.tag in ("article", "main"):
            y = x.parent
            while y is not None and id(y) not in around:
                around.add(id(y))
                y = y.parent
    inside: dict[int, bool] = {}
    for x in nodes:  # parents come first
        up = x.parent
        inside[id(x)] = up is not None and (inside[id(up)] or up.tag in ("article", "main"))
        if up is not None and up.drop == 1:
            x.drop = 1
        elif x.drop == 2:
            x.drop = int(not inside[id(x)] and id(x) not in around)
        elif x.drop == 3:
            x.drop = int(id(x) not in around)
        if x.tag == "button" and up is not None and up.tag in RUNNING and not up.drop:
            x.drop = 0


def densities(nodes: list[Node]) -> None:
    """Characters, tags and composite density of every live node, and the sum of its children's densities.

    Tags are those that shape the page: blocks and links. Inline formatting belongs to the text around it, so
    the blocks in an inline element are children of the block around that."""
    live = [x for x in nodes if not x.drop]
    for x in live:
        x.chars = x.link_chars = x.tags = x.link_tags = 0
    for x in reversed(live):
        for k in x.kids:
            if isinstance(k, str):
                x.chars += len(k.strip())
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.tags + 1
        if x.parent is not None:
            up = x.parent
            up.chars += x.chars
            up.link_chars += x.link_chars
            up.tags += x.tags + (x.tag in BLOCK or x.tag == "a")
            up.link_tags += x.link_tags
    body = next((x for x in live if x.tag == "body"), live[0])
    share = body.link_chars / max(1, body.chars)
    for x in live:
        c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
        plain = max(1, c - x.link_chars)
        base = math.log(c / plain * lc + share * c + math.e)
        x.density = c / t * math.log(max(1.0, c / lc * t / lt) + math.e - 1) / base if c else 0.0
        x.total = 0.0
    for x in reversed(live):
        if x.parent is not None:
            x.parent.total += x.density if x.tag in BLOCK else x.total


def choose(nodes: list[Node]) -> Node:
    live = [x for x in nodes if not x.drop]
    body = next((x for x in live if x.tag == "body"), live[0])
    best = max(live, key=lambda x: (x.total, x.chars))
    path, x = [], best
    while x is not None:
        path.append(x)
        x = x.parent
    upto = path[: path.index(body) + 1] if body in path else path
    least = min(x.density for x in upto)
    while best is not body and best.parent is not None:
        others = [k for k in best.parent.kids if not isinstance(k, str) and not k.drop and k is not best and k.chars]
        if any(k.density >= least for k in others) or any(isinstance(k, str) and k.strip() for k in best.parent.kids):
            best = best.parent
        elif len(others) == 0:
            best = best.parent
        else:
            break
    return best


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node``, in page order."""
    out, held = [], []

    def end() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        elif not x.drop:
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(x.kids))
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    _, nodes = parse(page)
    prune(nodes)
    if not any(not x.drop for x in nodes):
        return ""
    densities(nodes)
    return "\n\n".join(blocks(choose(nodes)))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                text = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
