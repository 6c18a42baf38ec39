"""Pages as trees: every element with its parent, its subtree, its siblings and its place in the visible text.

A small function tokenizes bodies in Arrow batches, in chunks of a quarter of a megabyte, and keeps a stack of open elements; all that is read
from the tree (labels, cards, siblings) is column expressions over its nodes. An end tag that is missing is supplied where an
element of the same group opens inside the same container (li in a list, dt and dd, rows and cells in a table, p before a block); an end tag without a begin is
ignored; whatever is open at the end of a page ends there. Nested tables and lists stay inside their cell or item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "tag:string,classes:string,href:string,parent:int,last:int,next:int,dd:int,begin:int,end:int,hidden:boolean"
NAMES = [f.split(":")[0] for f in NODE.split(",")]
KINDS = [pa.string()] * 3 + [pa.int32()] * 6 + [pa.bool_()]
CHUNK = 1 << 18  # lists and strings of a page's tree take tens of times the room of its text

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("noscript", "svg"))
CELLS, ROWS = frozenset(("td", "th")), frozenset(("tr",))
#: What an opening tag closes, and the containers within which it looks for it.
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (CELLS, frozenset(("tr", "table"))), "th": (CELLS, frozenset(("tr", "table"))), "tr": (ROWS, frozenset(("table",))), "option": (frozenset(("option",)), frozenset(("select",))),
} | {t: (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))) for t in ("thead", "tbody", "tfoot")}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
PARAGRAPH = (frozenset(("p",)), frozenset(("td", "th", "li", "dd", "dt", "div", "section", "article", "button", "table", "body")))


def attributes(text: str) -> tuple[str | None, str | None]:
    """The class and href attributes of a tag; of a repeated attribute the first counts."""
    if "=" not in text:
        return None, None
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return found.get("class"), found.get("href")


def tree(html: str | None) -> tuple[str, list[list]]:
    """The visible text of a page, with single spaces, and its elements in the order of the page (see ``NODE``): ``last`` is the last element of the subtree, ``next`` the
    next sibling, ``dd`` the next sibling of that name (-1: none), ``begin`` and ``end`` the subtree's place in the text."""
    nodes: list[list] = []
    stack: list[int] = []
    pieces: list[str] = []
    at = hidden = 0

    def close(depth: int) -> None:
        nonlocal hidden
        while len(stack) > depth:
            node = nodes[stack.pop()]
            node[4], node[8] = len(nodes) - 1, max(at - 1, node[7])
            hidden -= node[0] in HIDDEN

    def close_implied(rule: tuple[frozenset, frozenset]) -> None:
        names, borders = rule
        for depth in range(len(stack) - 1, -1, -1):
            tag = nodes[stack[depth]][0]
            if tag in names:
                return close(depth)
            if tag in borders:
                return None

    for raw, end, name, rest, text in TOKEN.findall(html or ""):
        if text:
            if not hidden and (words := unescape(text).split()):
                pieces.append(" ".join(words))
                at += len(pieces[-1]) + 1
        elif name:
            tag = name.lower()
            if end:
                for depth in range(len(stack) - 1, -1, -1):
                    if nodes[stack[depth]][0] == tag:
                        close(depth)
                        break
                    if nodes[stack[depth]][0] == "table" and tag not in ("table", "html", "body"):
                        break  # an end tag does not reach out of a table
                continue
            if tag in CLOSES:
                close_implied(CLOSES[tag])
            if tag in BLOCKS:
                close_implied(PARAGRAPH)
            classes, href = attributes(rest)
            nodes.append([tag, classes, href, stack[-1] if stack else -1, len(nodes), -1, -1, at, at, hidden > 0])
            if tag not in VOID and not rest.endswith("/"):
                stack.append(len(nodes) - 1)
                hidden += tag in HIDDEN
    close(0)
    following: dict[int, int] = {}
    defined: dict[int, int] = {}
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        node[5], node[6] = following.get(node[3], -1), defined.get(node[3], -1)
        following[node[3]] = k
        if node[0] == "dd":
            defined[node[3]] = k
    return " ".join(pieces), nodes


def in_chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``CHUNK`` bytes of a text column; a longer text is a slice of its own."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        at = size = 0
        for k, n in enumerate(sizes):
            if k > at and size + n > CHUNK:
                yield b.slice(at, k - at)
                at, size = k, 0
            size += n
        if b.num_rows:
            yield b.slice(at)


def parsed(pages: DataFrame, key: list[str], column: str = "html") -> DataFrame:
    """(key, text, nodes) of every page, where it lies; a null page is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_chunks(batches, len(key)):
            found = [tree(t) for t in part.column(len(key)).to_pylist()]
            flat = [n for _, nodes in found for n in nodes]
            columns = [pa.array(c, t) for c, t in zip(zip(*flat, strict=True), KINDS, strict=True)] if flat else [pa.array([], t) for t in KINDS]
            ends = [0]
            for _, nodes in found:
                ends.append(ends[-1] + len(nodes))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, NAMES))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(key)], pa.array([t for t, _ in found], pa.string()), lists], [*key, "text", "nodes"])

    own = pages.select(*key, F.col(column).cast("string"))
    kinds = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in key)
    return own.mapInArrow(run, f"{kinds}, text string, nodes array<struct<{NODE}>>")


def text_of(text: Column, node: Column) -> Column:
    """The visible text of a node's subtree."""
    return F.substring(text, node["begin"] + 1, node["end"] - node["begin"])


def below(nodes: Column, at: Column, node: Column) -> Column:
    """The nodes of a subtree, without its root."""
    return F.slice(nodes, at + 2, node["last"] - at)


def has_class(node: Column, *names: str) -> Column:
    """Whether a node has one of the classes."""
    return F.coalesce(node["classes"].rlike(rf"(?:^|\s)(?:{'|'.join(names)})(?:\s|$)"), F.lit(False))


def numbered(nodes: Column, good) -> Column:
    """(at, node) of the nodes for which ``good`` holds, in the order of the page; hidden ones are left out."""
    every = F.transform(nodes, lambda n, k: F.struct(k.alias("at"), n.alias("node")))
    return F.filter(every, lambda x: ~x["node"]["hidden"] & good(x["node"]))


def with_classes(nodes: Column, names: tuple[str, ...]) -> Column:
    """(at, node) of the nodes that have one of the classes; the names are patterns."""
    return numbered(nodes, lambda n: has_class(n, *names))
