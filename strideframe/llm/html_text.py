"""Layout-aware text of HTML pages.

A tree builder reads the tags, closes what HTML lets authors leave open (paragraphs, list items, table
parts, options), opens the rows that cells lack, moves what stands between cells before the table and ignores stray end tags. It
reads forward once, also where tags or quotes never end. The renderer walks the tree without recursion and emits all visible text: scripts,
styles, heads, templates, comments and elements hidden by attribute or inline style are left out (``visibility`` is inherited until a descendant sets it anew);
blocks stand on lines of their own, paragraphs and the like between blank lines; list items get bullets or
numbers and the indent of their depth; table cells are laid out in aligned columns; ``pre`` keeps its spaces.

Defined results: null or empty HTML has an empty text; broken markup gives what its readable parts say; a tag that never ends is text. Long
pages are taken whole; repeated rows give a row each; an empty table gives an empty one; other columns pass, whatever their names.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist rp".split())
#: What svg and math hold but do not show.
UNSEEN = frozenset("desc metadata symbol clippath mask marker pattern annotation annotation-xml mphantom".split())
#: Where svg and math hold HTML or text again.
INTEGRATION = frozenset("foreignobject mi mn mo ms mtext".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
BLOCK = SPACED | frozenset("html body div li dt dd tr article aside section header footer main nav address form figcaption details summary center hr legend option caption menu".split())
#: An opening tag closes the nearest open element of the second set, but not past one of the third.
_CELL = frozenset({"td", "th"})
IMPLIED = {
    **{t: (frozenset({"p"}), frozenset("td th li div button table body html".split())) for t in "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
#: Parts of a table that hold no text of their own, and what the innermost open one of tells where a tag stands.
_SECTION = frozenset({"thead", "tbody", "tfoot"})
_INNER = _SECTION | {"table", "tr"}
_TABLE = _INNER | _CELL | {"caption", "template"}
#: What a tag of a table stands in: all that is open within it closes.
PARENT = {**dict.fromkeys(_SECTION | {"caption", "colgroup", "col"}, frozenset({"table"})), "tr": _SECTION | {"table"}, **dict.fromkeys(_CELL, _INNER)}
#: What an end tag does not reach past.
SCOPE = {**{t: frozenset({"table"}) for t in ("td", "th", "tr", "tbody", "thead", "tfoot", "p", "li", "div", "span", "b", "i", "a", "em", "strong", "form")}, "li": frozenset({"ul", "ol", "table"})}

MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLANK = re.compile(r"[\t\n\x0b\x0c\r ]+")
DECLARATION = re.compile(r"((?:[^;:\"'(]|\"[^\"]*\"|'[^']*'|\([^()]*\)|[\"'(])+):((?:[^;\"'(]|\"[^\"]*\"|'[^']*'|\([^()]*\)|[\"'(])*)")
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
MAY_HIDE = re.compile(r"none|visibility", re.I)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Stack(list):
    """The open elements, and for each tag the places of its open ones, so that the nearest of some tags is found at once."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self))
        self.append(node)

    def cut(self, at: int) -> None:
        for node in reversed(self[at:]):
            self.places[node.tag].pop()
        del self[at:]

    def nearest(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max([self.places[t][-1] for t in tags if t in self.places and self.places[t]], default=0)


class Ends:
    """Where tags end: at the next ``>`` outside quotes. Stops from which no end was found are kept, so that all searches together are one pass."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.since, self.stop = 0, -1  # the stop next to any place between these two
        self.failed: set[int] = set()

    def end(self, at: int) -> int:
        """The place of the ``>``, or -1."""
        path = []
        while at <= self.last:
            if not self.since <= at <= self.stop:
                m = STOP.search(self.source, at)
                self.since, self.stop = at, m.start()  # the last ``>`` at the latest
            k = self.stop
            if k in self.failed:
                break
            if self.source[k] == ">":
                return k
            path.append(k)
            close = self.source.find(self.source[k], k + 1)
            if close < 0:
                break
            at = close + 1
        self.failed.update(path)
        return -1


def parse(source: str) -> Node:
    """The tree of a page: children are nodes or texts."""
    root = Node("#root", {})
    stack, ends, at, n, held = Stack(root), Ends(source), 0, len(source), []
    while at < n:
        m = MARKUP.search(source, at)
        held.append(source[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        if m[2] is not None:
            end = ends.end(at)
            if end < 0:  # text
                held.append(m[0])
                continue
        if text := "".join(held):
            _put(stack, html.unescape(text))
        held = []
        if m[2] is None:
            continue
        rest, at = source[at:end], end + 1
        tag = m[2].lower()
        if m[1]:
            _close(stack, frozenset({tag}), SCOPE.get(tag, frozenset()))
            continue
        if tag in IMPLIED:
            _close(stack, *IMPLIED[tag])
        if tag in PARENT or tag == "table":
            _enter(stack, tag)
        attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in reversed(ATTR.findall(rest))} if rest.strip() else {}
        node = Node(tag, attrs)
        _put(stack, node)
        empty = rest.endswith("/") and (tag in ("svg", "math") or _foreign(stack))
        if tag in UNSEEN and _foreign(stack):
            attrs["hidden"] = ""
        if tag in RAW and not empty:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            body = source[at : close.start() if close else n]
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            at = close.end() if close else n
        elif tag not in VOID and not empty and not (tag == "colgroup" or (tag == "form" and stack[-1].tag in _INNER)):
            stack.push(node)
    if text := "".join(held):
        _put(stack, html.unescape(text))
    return root


def _foreign(stack: Stack) -> bool:
    """Whether the next tag is one of svg or math."""
    return stack.nearest(("svg", "math")) > stack.nearest(INTEGRATION)


def _close(stack: Stack, tags: frozenset[str], stop: frozenset[str]) -> None:
    at = stack.nearest(tags)
    if at and at >= stack.nearest(stop):
        stack.cut(at)


def _enter(stack: Stack, tag: str) -> None:
    """Make room for a tag of a table: close what it can't stand in, open the row that a cell lacks."""
    at = stack.nearest(_TABLE)
    if tag == "table":  # a table right inside another one ends it
        if at and stack[at].tag in _INNER:
            _close(stack, frozenset({"table"}), frozenset())
        return
    at = stack.nearest(PARENT[tag])
    if not at or at < stack.nearest(("template",)):
        return
    stack.cut(at + 1)
    if tag in _CELL and stack[at].tag != "tr":
        row = Node("tr", {})
        stack[at].children.append(row)
        stack.push(row)


def _put(stack: Stack, item: Node | str) -> None:
    """Add a text or element; what can't stand between the cells of a table goes before the table."""
    to = stack[-1].children
    if stack[-1].tag in _INNER and (item.strip() if isinstance(item, str) else item.tag not in PARENT):
        k = stack.nearest(("table",))
        if k:
            to = stack[k - 1].children
            at = next((i for i in range(len(to) - 1, -1, -1) if to[i] is stack[k]), len(to))
            to.insert(at, item)
            return
    to.append(item)


def declared(style: str) -> dict[str, str]:
    """The properties of an inline style, in lower case; the last declaration counts, an important one before others."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value in DECLARATION.findall(CSS_COMMENT.sub(" ", style)):
        value, mark, rest = value.lower().partition("!")
        important, name = bool(mark) and rest.strip() == "important", name.strip().lower()
        if value.strip() and (important or not out.get(name, (False,))[0]):
            out[name] = important, value.strip()
    return {name: value for name, (_, value) in out.items()}


def _style(node: Node) -> dict[str, str]:
    style = node.attrs.get("style", "")
    return declared(style) if MAY_HIDE.search(style) else {}


def left_out(node: Node) -> bool:
    """Whether the element and all in it is not rendered."""
    if node.tag == "dialog" and "open" not in node.attrs:
        return True
    return node.tag in HIDDEN or "hidden" in node.attrs or (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden") or _style(node).get("display") == "none"


def shows(node: Node, inherited: bool) -> bool:
    """Whether the texts right inside a rendered element are visible."""
    own = _style(node).get("visibility")
    return inherited if own in (None, "inherit") else own not in ("hidden", "collapse")


class Lines:
    """Text being laid out: lines, with the space between blocks held back until text follows."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.gap, self.space = 0, False
        self.indent, self.mark = 0, ""

    def block(self, blank: bool) -> None:
        if self.line:
            self.done.append("".join(self.line))
            self.line = []
            self.gap = 0
        self.gap, self.space = max(self.gap, int(blank)), False

    def _open(self) -> None:
        if not self.line:
            if self.done and self.gap:
                self.done.append("")
            self.gap = 0
            mark, self.mark = self.mark, ""
            self.line.append(" " * max(0, self.indent - len(mark)) + mark)

    def words(self, text: str) -> None:
        body = BLANK.sub(" ", text)
        core = body.strip(" ")
        if body[:1] == " " and self.line:
            self.space = True
        if not core:
            return
        fresh = not self.line
        self._open()
        self.line.append(" " + core if self.space and not fresh else core)
        self.space = body[-1] == " "

    def kept(self, text: str) -> None:
        for k, row in enumerate(text.split("\n")):
            if k:
                self.newline()
            if row:
                self._open()
                self.line.append(row)

    def newline(self) -> None:
        self._open()
        self.done.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def rows(self, rows: list[str]) -> None:
        for r in rows:
            self._open()
            self.line.append(r)
            self.block(False)

    def text(self) -> str:
        self.block(False)
        rows = [r.rstrip() for r in self.done]
        return "\n".join(rows).strip("\n")


def _int(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"-?\d{1,6}", value.strip()) else default


def _grid(table: Node, shown: bool) -> list[list[tuple[Node | None, int, bool]]]:
    """Rows of a table as (cell, columns it spans, whether it shows); cells that span rows leave blanks below them."""
    rows, todo, found = [], [(table, shown)], []
    while todo:
        node, seen = todo.pop()
        for c in reversed(node.children):
            if isinstance(c, Node) and not left_out(c) and c.tag in ("thead", "tbody", "tfoot", "tr"):
                todo.append((c, shows(c, seen)))
        if node.tag == "tr":
            found.append((node, seen))
    below: dict[int, int] = {}
    for tr, seen in found:
        row, at = [], 0
        for cell in [c for c in tr.children if isinstance(c, Node) and c.tag in _CELL and not left_out(c)]:
            while below.get(at, 0) > 0:
                below[at] -= 1
                row.append((None, 1, False))
                at += 1
            span, deep = min(max(_int(cell.attrs.get("colspan"), 1), 1), 1000), min(max(_int(cell.attrs.get("rowspan"), 1), 1), 65534)
            row.append((cell, span, shows(cell, seen)))
            for k in range(at, at + span):
                below[k] = deep - 1
            at += span
        rows.append(row)
    return rows


def columns_of(text: str) -> int:
    """How many columns a text takes where letters stand in a grid: wide ones two, marks above others none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _layout(cells: list[list[tuple[list[str], int]]]) -> list[str]:
    """Rows of (lines of a cell, span) in columns of the width of their widest one-column cell."""
    width: dict[int, int] = {}
    for row in cells:
        at = 0
        for lines, span in row:
            if span == 1:
                width[at] = max(width.get(at, 0), *map(columns_of, lines), 0)
            at += span
    out = []
    for row in cells:
        high = max([len(lines) for lines, _ in row], default=0)
        for k in range(high):
            at, parts = 0, []
            for lines, span in row:
                room = sum(width.get(c, 0) for c in range(at, at + span)) + 3 * (span - 1)
                line = lines[k] if k < len(lines) else ""
                parts.append(line + " " * (room - columns_of(line)))
                at += span
            out.append(" | ".join(parts).rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    out = Lines()
    frames: list[list] = [[iter(root.children), out, None, 0, True]]  # children left, where text goes, what to do at the end, pre depth, visible
    counters: list[int | None] = []
    while frames:
        children, to, end, pre, shown = frames[-1]
        child = next(children, None)
        if child is None:
            frames.pop()
            if end:
                end()
            continue
        if isinstance(child, str):
            if shown:
                (to.kept if pre else to.words)(child)
            continue
        tag = child.tag
        if left_out(child):
            continue
        shown = shows(child, shown)
        if tag == "br":
            if shown:
                to.newline()
        elif tag == "wbr":
            pass
        elif tag == "table":
            _open_table(child, frames, to, pre, shown)
        elif tag in BLOCK:
            spaced = tag in SPACED and not (tag in ("ul", "ol") and counters)
            to.block(spaced)
            shift = 0
            if tag in ("ul", "ol", "menu"):
                counters.append(_int(child.attrs.get("start"), 1) if tag == "ol" else None)
            elif tag == "li":
                at = counters[-1] if counters else None
                if at is not None:
                    at = _int(child.attrs.get("value"), at)
                    counters[-1] = at + 1
                shift = 4 if at is not None else 2
                to.mark = f"{at}. " if at is not None else "- "
            elif tag in ("blockquote", "dd"):
                shift = 2
            to.indent += shift

            def close(to=to, shift=shift, tag=tag, spaced=spaced):
                to.block(spaced)
                to.indent -= shift
                if tag == "li":
                    to.mark = ""
                elif tag in ("ul", "ol", "menu"):
                    counters.pop()

            inside = child.children
            if tag == "details" and "open" not in child.attrs:  # closed: its first summary alone shows
                inside = [c for c in inside if isinstance(c, Node) and c.tag == "summary"][:1]
            frames.append([iter(inside), to, close, pre + (tag == "pre"), shown])
        elif tag == "text" and not pre:  # of svg: placed by itself
            to.words(" ")
            frames.append([iter(child.children), to, lambda to=to: to.words(" "), pre, shown])
        elif tag == "q" and shown:
            to.words("“")
            frames.append([iter(child.children), to, lambda to=to: to.words("”"), pre, shown])
        else:
            frames.append([iter(child.children), to, None, pre + (tag in ("textarea", "xmp")), shown])
    return out.text()


def _open_table(table: Node, frames: list[list], to: Lines, pre: int, shown: bool) -> None:
    """Lay out every cell by itself, then the rows; a caption and text outside cells come first."""
    to.block(True)
    grid = _grid(table, shown)
    cells = [[(Lines(), span) for _, span, _ in row] for row in grid]

    def close():
        to.rows(_layout([[(sub.text().split("\n"), span) for sub, span in row] for row in cells]))
        to.block(True)

    frames.append([iter(()), to, close, pre, shown])
    for row, subs in zip(reversed(grid), reversed(cells), strict=True):
        for (cell, _, seen), (sub, _) in zip(reversed(row), reversed(subs), strict=True):
            if cell is not None:
                frames.append([iter(cell.children), sub, None, pre, seen])
    loose = [c for c in table.children if (isinstance(c, str) and c.strip()) or (isinstance(c, Node) and c.tag not in ("thead", "tbody", "tfoot", "tr", "colgroup", "col"))]
    frames.append([iter(loose), to, lambda: to.block(False), pre, shown])


def page_text(source: str | None) -> str:
    return render(parse(source)) if source else ""


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``html_col`` in ``out_col``, in place of the HTML."""
    rest = [f for f in pages.schema.fields if f.name not in (html_col, out_col)]
    base = pages.select(*[f.name for f in rest], F.col(html_col).alias("__html"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{out_col}` string"])

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = pa.array([page_text(h.as_py()).encode("utf-8", "replace").decode() for h in part.column("__html")], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in rest] + [texts], [f.name for f in rest] + [out_col])

    return base.mapInArrow(tidy(run), schema)
