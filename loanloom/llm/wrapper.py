"""Main text of web pages by wrapper induction.

Pages of a host share a template. Each page is parsed to a tree, in which siblings with the same
label (tag and first class, any number in it alike) count as one repeated node. Simple tree
matching aligns two nodes only if the labels of them and of all above them are equal, so trees of
any number of pages are aligned at once by these paths, and no page has to stand for the others.
Over all pages of the host it is counted how often the same text stands at the same node; text
that is there on at least half of the pages that have the node, and on three that are not all
alike, is template, and what varies is content. A kind of page that few pages of a host have, with
nodes of its own, so has a template of its own. Structure can be template too where the words change: a
node outside <article> and <main> that at least half of all pages of the host have, and three that are
not all alike, is a menu if over all these pages at least half of its text is in links and it holds under
half of the host's text.

Extraction aligns each page with its host's template again and leaves out

- what is never text: scripts, styles, comments in the markup, the head;
- what a tag, a role or a class says is a menu, header, footer, sidebar, notice, advert, form or
  reader comment (the lists below);
  A class word doesn't count if it says that something is or isn't there (has-sidebar), nor for an
  <article> or <main> below, unless it is a word for reader comments, nor on hosts where that
  element holds most of the text on at least half of the pages that have it, and on three. If
  nothing else is left of a page, the text that class words took is given back, but for blocks
  that are mostly links;
- menus, as the host's pages show them, whatever their tags and classes;
- template text, whatever its tag and wherever it stands. Within <article> or <main> lines that
  <br> parts are one paragraph, which goes only if all of its lines are template.

Of what is left, only that within <article> (or else <main>) is taken if it is at least half of
it. On a host without a template nothing tells text from notices, so there a single <article>, or
<main>, is taken whatever its share. Where neither is taken there, blocks that are mostly links are
left out.

Character references are decoded, white space in a block is one space, blocks are joined in page
order by one space. Null and empty pages give an empty text. A page whose url has no host, or is
null, has no template. Repeated rows are treated alike, and count as pages; copies of one page alone
make no template. An empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import pieces
from loanloom.sources.store import stored

#: Elements nested deeper than this count as their ancestor there; their text is kept.
DEPTH = 100
#: Share of the pages that have a node, and number of pages, on which template text stands.
SHARE, PAGES = 0.5, 3
#: Stands for text at a node that holds most of a page, and for that of a menu.
LARGE, MENU = 0, 1
#: What is counted of the nodes of a page.
COUNTED = {"host": pa.string()} | dict.fromkeys("node said page length linked".split(), pa.int64())

#: Kinds of elements, roles and class words; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noframes".split())
SILENT = RAW | frozenset("head svg math canvas object audio video map select button datalist".split())
#: What may stand in a head; anything else ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: What ends other silent elements whose own end is missing.
SECTIONS = frozenset("article aside body footer form header main nav section".split())
#: Elements within svg and math that hold ordinary text and blocks.
FOREIGN = ("foreignobject", "desc", "annotation-xml")
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu "
    "nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body html option td th tr tbody thead tfoot caption li dd dt legend".split())
#: An open element that one of these ends, and where looking for it stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
SIDE_TAGS = frozenset("nav footer aside dialog menu".split())
SIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split()
)
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav "
    "navbar navigation menu sidebar aside footer masthead topbar cookie cookies consent gdpr notice "
    "notices banner popup modal overlay alert comment comments commentlist respond disqus reply "
    "replies discussion related recommended share sharing social breadcrumb breadcrumbs newsletter subscribe "
    "signup login search pagination pager widget toolbar skip".split()
)

COMMENT_WORDS = frozenset("comment comments commentlist respond disqus reply replies discussion".split())
#: Beginnings of a class that tell of a layout, not of the element.
_TELLS = re.compile(r"(?:has|have|no|not|with|without|hide|hides|show|shows)(?:[-_]|(?=[A-Z]))")

#: A comment, a tag (its end may be missing before the next one or the end of the page; a quote
#: that doesn't begin a value, or has no partner, is an ordinary sign), or another declaration.
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>?"
    r"|<[!?/][^>]*>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"\d+")
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: label, whether it is no content, children by label, hash of its path, and number."""

    __slots__ = ("tag", "label", "side", "children", "path", "number", "size")

    def __init__(self, tag: str, label: str, side: bool, path: int = 0):
        self.tag, self.label, self.side, self.path = tag, label, side, path
        self.children: dict[str, Node] = {}
        self.number = self.size = 0


class Block:
    """Text of one block: its node, paragraph, where it stands, and how much of it is in links."""

    __slots__ = ("node", "paragraph", "parts", "side", "marks", "inside", "linked", "text")

    def __init__(self, node: Node, paragraph: int, side: bool, marks: tuple, inside: tuple[int, bool]):
        self.node, self.paragraph, self.side, self.marks, self.inside = node, paragraph, side, marks, inside
        self.parts: list[str] = []
        self.linked = 0
        self.text = ""


@lru_cache(maxsize=4096)
def _kind(tag: str, attributes: str) -> tuple[str, bool, bool, str]:
    """Label, whether the element is no content, whether it is a page header, and by its class or
    id "side", "header", "comment" or nothing."""
    side = tag in SIDE_TAGS
    first, says = "", "side" if tag == "form" else ""
    seen = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).strip()
        if name in seen:
            continue
        seen.add(name)
        if name == "role":
            side |= value.lower() in SIDE_ROLES
        elif name == "hidden":
            side |= value.lower() in ("", "hidden", "true")
        elif name == "style":
            side |= bool(_HIDDEN.search(value))
        elif name in ("class", "id"):
            tokens = [t for t in value.split() if not _TELLS.match(t)]
            words = {w.lower() for t in tokens for w in _CLASS_WORD.findall(t)}
            if tag not in ("html", "body", "article", "main"):
                if words & COMMENT_WORDS:
                    says = "comment"
                elif words & SIDE_WORDS:
                    says = says or "side"
                elif "header" in words:
                    says = says or "header"
            if name == "class" and value:
                first = "." + _DIGITS.sub("#", value.split()[0])
    return tag + first, side, tag == "header", says


@lru_cache(maxsize=65536)
def _path_below(path: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), path & (1 << 64) - 1) - (1 << 63)


def _path(above: Node, label: str) -> int:
    return _path_below(above.path, label)


def parse(page: str) -> tuple[Node, list[Block]]:
    """The tree and the blocks of text, in page order; silent elements are left out."""
    root = Node("#root", "#root", False)
    blocks: list[Block] = []
    # open elements: (tag, node, no content, (number of the outermost article, within main), in a link, marks:
    # (path, kind) of those whose class says that they are no content)
    stack: list[tuple[str, Node, bool, tuple[int, bool], bool, tuple]] = [
        ("#root", root, False, (0, False), False, ())
    ]
    opened: dict[str, int] = {}
    block: Block | None = None
    at, n = 0, len(page)
    silent, lost = "", False  # the open silent element, and whether its end is missing
    within: dict[str, int] = {}  # elements open in it
    ends: dict[str, int] = {}
    articles = paragraph = 0

    def add(text: str) -> None:
        nonlocal block
        _, _, side, inside, link, marks = stack[-1]
        if block is not None and (block.side, block.marks) != (side, marks) and text.strip():
            block = None  # an inline element within the block that is no content, or its end
        if block is None:
            if not text.strip():
                return
            node = next(e[1] for e in reversed(stack) if e[0] in BLOCK or e[0] == "#root")
            block = Block(node, paragraph, side, marks, inside)
            blocks.append(block)
        block.parts.append(text)
        if link:
            block.linked += len(text.strip())

    def has_end(tag: str) -> bool:
        if ends.get(tag, -1) < at:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            ends[tag] = end.start() if end else n
        return ends[tag] < n

    for m in _TAG.finditer(page):
        start = m.start()
        if start < at:
            continue
        if start > at:
            if silent == "head" and page[at:start].strip():
                silent = ""
            if not silent:
                add(page[at:start])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        closing = m.group(1)
        attributes = m.group(3)
        if silent and closing:
            if within.get(tag):
                within[tag] -= 1
                continue
            if tag != silent and not opened.get(tag):
                continue
            ended, silent = silent, ""
            if tag == ended:
                continue
        elif silent and _ends_silent(silent, lost, tag, within):
            silent = ""
        elif silent and (tag not in RAW or attributes.endswith("/")):
            if tag not in VOID and not attributes.endswith("/"):
                within[tag] = within.get(tag, 0) + 1
            continue
        if closing:
            if tag in BLOCK:
                block = None
                paragraph += tag != "br"
            if opened.get(tag):
                while opened[tag] and stack[-1][0] != tag:
                    opened[stack.pop()[0]] -= 1
                opened[stack.pop()[0]] -= 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = end.start() if end else n
            if end:
                at = page.find(">", at) + 1 or n
            continue
        if tag in SILENT:
            if not attributes.endswith("/"):
                silent, lost, within = tag, not has_end(tag), {}
            continue
        if tag in BLOCK:
            block = None
            paragraph += tag != "br"
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            _end(stack, opened, ("p",), ("article", "main", "section", "div", "td", "th", "li", "body", "button"))
        if tag in ENDS:
            _end(stack, opened, *ENDS[tag])
        label, side, header, says = _kind(tag, attributes)
        _, above, was_side, inside, link, marks = stack[-1]
        if tag in ("article", "main"):
            marks = tuple(k for k in marks if k[1] == "comment")
        if tag == "article" and not inside[0]:
            articles += 1
            inside = (articles, inside[1])
        elif tag == "main":
            inside = (inside[0], True)
        node = above
        if tag in BLOCK and len(stack) <= DEPTH:
            node = above.children.get(label)
            if node is None:
                node = above.children[label] = Node(tag, label, side, _path(above, label))
        side = was_side or side or (header and not any(inside))
        if says and len(marks) < DEPTH and (says != "header" or not any(inside)):
            marks = (*marks, (_path(above, label), says))
        if not attributes.endswith("/") or tag in BLOCK:
            stack.append((tag, node, side, inside, link or tag == "a", marks))
            opened[tag] = opened.get(tag, 0) + 1
    if at < n and silent in ("", "head"):
        add(page[at:])
    for b in blocks:
        b.text = " ".join(_html.unescape("".join(b.parts)).split())
    return root, [b for b in blocks if b.text]


def _ends_silent(silent: str, lost: bool, tag: str, within: dict[str, int]) -> bool:
    """Whether a start tag shows that a silent element is over."""
    if silent == "head":
        return tag not in HEAD and tag != "head"
    if silent in ("svg", "math"):
        return tag in BLOCK and not any(within.get(t) for t in FOREIGN)
    if silent == "select":
        return tag in ("select", "input", "textarea") or tag in BLOCK - {"option", "hr", "legend", "div"}
    return (silent == "button" and tag == "button") or tag in SECTIONS or (lost and tag in BLOCK)


def _end(stack: list, opened: dict[str, int], tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
    """Close open elements of the given tags, the last ones first."""
    if not any(opened.get(t) for t in tags):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in stop:
            return
        if stack[i][0] in tags:
            for e in stack[i:]:
                opened[e[0]] -= 1
            del stack[i:]
            if len(tags) == 1:
                return


def number(node: Node, at: int = 0) -> int:
    """Number the nodes in page order and count the nodes below; gives the next number."""
    node.number = at
    at += 1
    for child in node.children.values():
        at = number(child, at)
    node.size = at - node.number
    return at


def as_json(node: Node) -> str:
    def plain(x: Node) -> list:
        return [x.label, [plain(c) for c in x.children.values()]]

    return json.dumps(plain(node), separators=(",", ":"))


def from_json(text: str) -> Node:
    def build(x: list) -> Node:
        node = Node("", x[0], False)
        node.children = {c[0]: build(c) for c in x[1]}
        return node

    root = build(json.loads(text))
    number(root)
    return root


def match(a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the number of matched nodes and the pairs of their numbers."""
    if a.label != b.label:
        return 0, []
    ours, theirs = list(a.children.values()), list(b.children.values())
    if [c.label for c in ours] == [c.label for c in theirs]:
        found = [match(x, y) for x, y in zip(ours, theirs, strict=True)]
        return 1 + sum(f[0] for f in found), [(a.number, b.number), *(p for f in found for p in f[1])]
    m, n = len(ours), len(theirs)
    inner = {(i, j): match(x, y) for i, x in enumerate(ours) for j, y in enumerate(theirs) if x.label == y.label}
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + inner.get((i, j), (0, ()))[0])
    pairs, i, j = [(a.number, b.number)], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += inner[i, j][1]
    return 1 + best[m][n], pairs


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def places(page: str) -> tuple[dict[int, tuple[int, int]], set[tuple[int, int]], int]:
    """Nodes of a page by path, with the lengths of their own text outside <article> and <main> and of what
    is in links of it; pairs of a path and a hash of the text there; a hash of all.

    The root has the length of all text of the page. An element that its class calls no content has the
    text LARGE if it holds most of the text.
    """
    root, blocks = parse(page)
    nodes, todo = {}, [root]
    while todo:
        node = todo.pop()
        nodes[node.path] = (0, 0)
        todo += node.children.values()
    for b in blocks:
        if not any(b.inside):
            length, linked = nodes[b.node.path]
            nodes[b.node.path] = (length + len(b.text), linked + min(b.linked, len(b.text)))
    nodes[root.path] = (sum(len(b.text) for b in blocks), 0)
    said = {(b.node.path, _hash(b.text)) for b in blocks}
    whole = xxhash.xxh64_intdigest(repr([(b.node.path, b.text) for b in blocks]).encode()) - (1 << 63)
    usual = [b for b in blocks if not b.side]
    held: dict[int, int] = {}
    for b in usual:
        for path in {m[0] for m in b.marks}:
            held[path] = held.get(path, 0) + len(b.text)
    size = sum(len(b.text) for b in usual)
    for path in held:
        nodes.setdefault(path, (0, 0))
    return nodes, said | {(path, LARGE) for path, n in held.items() if n * 2 > size}, whole


def extract(page: str, template: frozenset[tuple[int, int]], menus: frozenset[int] = frozenset()) -> str:
    """The main text of a page; template: pairs of a path and a hash of text; menus: paths."""
    blocks = parse(page)[1] if page else []
    blocks = [b for b in blocks if not b.side and (any(b.inside) or b.node.path not in menus)]
    if template:
        varies = [(b.node.path, _hash(b.text)) not in template for b in blocks]
        kept = {b.paragraph for b, v in zip(blocks, varies, strict=True) if v and any(b.inside)}
        blocks = [b for b, v in zip(blocks, varies, strict=True) if v or b.paragraph in kept]
    unmarked = [b for b in blocks if all((m[0], LARGE) in template for m in b.marks)]
    blocks = unmarked or [b for b in blocks if b.linked * 2 <= len(b.text)]
    within = _within(blocks, bool(template))
    if within:
        blocks = within
    elif not template:
        blocks = [b for b in blocks if b.linked * 2 <= len(b.text)]
    return " ".join(b.text for b in blocks)


def _within(blocks: list[Block], template: bool) -> list[Block]:
    """The blocks in <article>, or else in <main>, if they are the main part of all."""
    size = sum(len(b.text) for b in blocks)
    articles = [b for b in blocks if b.inside[0]]
    if articles and not template and len({b.inside[0] for b in articles}) == 1:
        return articles
    if sum(len(b.text) for b in articles) * 2 >= size:
        return articles
    main = [b for b in blocks if b.inside[1]]
    return main if not template or sum(len(b.text) for b in main) * 2 >= size else []


def wrappers(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per host that has one: its template, pairs of a node's path and a hash of text.

    A node that is a menu has the text MENU.
    """
    rows = _with_host(pages, key, url, html).where("host IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                rows = []
                for host, page in zip(*(c.to_pylist() for c in piece.columns[:2]), strict=True):
                    nodes, said, whole = places(page)
                    rows += [(host, path, None, whole, *lengths) for path, lengths in nodes.items()]
                    rows += [(host, path, text, whole, 0, 0) for path, text in said]
                columns = list(zip(*rows, strict=True)) or [()] * len(COUNTED)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, COUNTED.values(), strict=True)], names=list(COUNTED)
                )

    # a null text counts the pages that have the node
    counted = stored(
        rows.select("host", "html")
        .mapInArrow(count, "host string, node long, said long, page long, length long, linked long")
        .groupBy("host", "node", "said")
        .agg(
            F.count("*").alias("n"),
            (F.min("page") < F.max("page")).alias("differ"),
            F.sum("length").alias("length"),
            F.sum("linked").alias("linked"),
        )
        .where(F.col("n") >= PAGES),
        "counted",
    )
    nodes = counted.where("said IS NULL")
    have = nodes.select("host", "node", F.col("n").alias("pages"))
    whole = nodes.where("node = 0").select("host", F.col("n").alias("pages"), F.col("length").alias("size"))
    menus = (
        nodes.where("differ AND length > 0 AND linked * 2 >= length")
        .join(whole, "host")
        .where((F.col("n") >= SHARE * F.col("pages")) & (F.col("length") * 2 < F.col("size")))
        .select("host", "node", F.lit(MENU).cast("long").alias("said"))
    )
    template = (
        counted.where("said IS NOT NULL AND differ")
        .join(have, ["host", "node"])
        .where(F.col("n") >= SHARE * F.col("pages"))
        .select("host", "node", "said")
        .unionByName(menus)
        .groupBy("host")
        .agg(F.collect_list(F.struct("node", "said")).alias("template"))
    )
    return stored(template, "wrappers")


def _with_host(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(
        F.col(key).cast("long").alias("id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
        F.when(host != "", host).alias("host"),
    )


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: key, url, text, n_chars."""
    found = wrappers(pages, key, url, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset, frozenset]] = {}
        for batch in batches:
            for piece in pieces(batch, 2):
                texts = []
                pages_, hosts = (piece.column(i).to_pylist() for i in (2, 3))
                for host, page, template in zip(hosts, pages_, piece.column(4), strict=True):
                    if host not in known:
                        if len(known) >= 512:
                            known.clear()
                        pairs = [(t["node"], t["said"]) for t in template.as_py() or ()]
                        known[host] = (
                            frozenset(p for p in pairs if p[1] != MENU),
                            frozenset(node for node, said in pairs if said == MENU),
                        )
                    texts.append(extract(page, *known[host]))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        piece.column(1),
                        pa.array(texts, pa.string()),
                        pa.array(map(len, texts), pa.int64()),
                    ],
                    names=[key, url, "text", "n_chars"],
                )

    rows = _with_host(pages, key, url, html).join(found, "host", "left")
    return rows.select("id", "url", "html", "host", "template").mapInArrow(
        run, f"{key} long, {url} string, text string, n_chars long"
    )
