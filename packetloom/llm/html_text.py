"""Operator 1: layout-aware text of web pages.

A page is cut into tags, text and comments; a tree builder supplies the end tags that HTML
leaves out, visibility rules drop what a browser does not show, and a renderer writes the
rest: blocks stand on lines of their own with a blank line around paragraphs and headings,
list items carry their bullet or number and their depth, preformatted text keeps its
spacing, and the cells of a table are padded so that columns align. All visible text is
emitted, navigation and asides included.

Every page is rendered where it is read: there is no shuffle.

Defined results: null html gives null text, empty html an empty text; a tag that the page
ends in is text, with all that follows it; formulas stand in the line without their annotations,
and of drawings the labels and embedded content; an unclosed comment hides the rest of the page, as in a browser; nesting
deeper than ``DEEPEST`` is flattened into the element at that depth; a table inside a cell
is rendered on its own and its lines become lines of the cell; below a cell that spans rows the
grid stays free, and columns without visible text take no place. In a table wider than
``WIDEST`` characters the cells of all columns but the last are wrapped between words; a word, preformatted text or inner table wider than its column stays whole.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import by_piece, with_columns

DEEPEST, WIDEST, NARROWEST = 200, 400, 16
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
HIDDEN = frozenset("head script style title noscript template iframe object audio video canvas datalist noembed noframes".split())
#: Elements of svg that show nothing themselves, and those whose content is text.
SVG_UNSEEN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
SVG_TEXT = frozenset("text foreignobject".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr legend li main menu nav ol p pre search section summary table ul caption tr optgroup option".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre figure".split())
ENDS_P = BLOCK - frozenset("html body dd dt li caption tr legend summary optgroup option".split()) | {"li", "dd", "dt"}
#: A start tag of the key closes open elements of the first set, up to the nearest of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    **{k: ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for k in ("thead", "tbody", "tfoot")},
    "body": ({"head"}, set()),
}
FENCES = frozenset("table td th caption".split())
#: Where markup starts, and the parts of a tag; a quote opens a value only straight after the equals sign.
MARKUP = re.compile(r"<(?:(?P<comment>!--)|(?P<close>/?)(?P<name>[A-Za-z][^ \t\n\r\f/>]*+)|[!?/])")
COMMENT_END = re.compile(r"--!?>")
BETWEEN = re.compile(r"[ \t\n\r\f/]*+")
NAME = re.compile(r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)([ \t\n\r\f]*+=[ \t\n\r\f]*+)?+")
BARE = re.compile(r"[^ \t\n\r\f>]*+")
SPACES = re.compile(r"[ \t\n\r\f]+")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)", re.I)


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool] | None:
    """(attributes, end, whether the tag ends itself) of a tag whose name ends at ``at``; None if the page ends first.

    The first of several attributes with one name counts. A quote that is never closed belongs to a bare value.
    """
    attrs: dict[str, str] = {}
    while True:
        between = BETWEEN.match(page, at)
        at = between.end()
        if at >= len(page):
            return None
        if page[at] == ">":
            return attrs, at + 1, between[0].endswith("/")
        m = NAME.match(page, at)
        at, value = m.end(), ""
        if m[2]:
            quote = page[at:at + 1]
            stop = page.find(quote, at + 1) if quote in ("'", '"') else -1
            if stop >= 0:
                value, at = page[at + 1:stop], stop + 1
            else:
                bare = BARE.match(page, at)
                value, at = bare[0], bare.end()
        attrs.setdefault(m[1].lower(), entities.unescape(value))


def build(page: str) -> Node:
    """The tree of a page, with implied end tags put in. Every character is looked at a bounded number of times."""
    root = Node("html", {})
    stack, at, end = [root], 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a:
            stack[-1].children.append(entities.unescape(page[a:b]))

    def close(names: set[str], fence: set[str] | frozenset[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in names:
                del stack[depth:]
            elif stack[depth].name in fence:
                return

    while (m := MARKUP.search(page, at)):
        name = (m["name"] or "").lower()
        if m["comment"]:
            text(at, m.start())
            inside = m.end()
            if page.startswith((">", "->"), inside):
                at = page.index(">", inside) + 1
            else:
                stop = COMMENT_END.search(page, inside)
                at = stop.end() if stop else end
            continue
        if not name:
            stop = page.find(">", m.end())
            if stop < 0:
                break
            text(at, m.start())
            at = stop + 1
            continue
        tag = _attributes(page, m.end())
        if tag is None:
            break
        text(at, m.start())
        attrs, at, ends_itself = tag
        if m["close"]:
            fence = FENCES - {name} if name not in ("tr", "table", "tbody", "thead", "tfoot") else frozenset(("table",)) - {name}
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
                if stack[depth].name in fence:
                    break
            continue
        if name in ("html", "body") and any(x.name == name for x in stack):
            continue
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in ENDS_P:
            close({"p"}, FENCES)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        # a tag can end itself only inside svg and math
        whole = ends_itself and any(x.name in ("svg", "math") for x in stack[1:] + [node])
        if name in ("annotation", "annotation-xml") and any(x.name == "math" for x in stack):
            node.attrs["hidden"] = ""
        if name in RAW and not whole:
            stop = re.compile(rf"</{name}(?=[ \t\n\r\f/>])", re.I).search(page, at)
            inner = page[at:stop.start() if stop else end]
            node.children.append(entities.unescape(inner) if name in ("title", "textarea") else inner)
            at = page.find(">", stop.end()) + 1 or end if stop else end
        elif name not in VOID and not whole and len(stack) < DEEPEST:
            stack.append(node)
    text(at, end)
    return root


def _visible(node: Node) -> bool:
    a = node.attrs
    return not (
        node.name in HIDDEN or "hidden" in a and a["hidden"].lower() != "until-found" or a.get("type", "").lower() == "hidden"
        or "style" in a and UNSEEN.search(a["style"]) or node.name == "dialog" and "open" not in a)


class Layout:
    """Lines of visible text; a break asked for several times is made once."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.blank = False
        self.marks = ""

    def word(self, text: str, keep: bool = False) -> None:
        if keep:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self._put(first)
            for x in rest:
                self.end(force=True)
                self._put(x)
            return
        flat = SPACES.sub(" ", text)
        if flat[:1] == " ":
            self.gap = True
        if body := flat.strip(" "):
            self._put((" " if self.gap and self.line else "") + body)
            self.gap = flat[-1] == " "

    def _put(self, text: str) -> None:
        if text:
            if not self.line:
                if self.blank and self.lines and self.lines[-1]:
                    self.lines.append("")
                self.blank = False
                if self.marks:
                    self.line.append(self.marks)
                    self.marks = ""
            self.line.append(text)

    def end(self, blank: bool = False, force: bool = False) -> None:
        if self.line or force:
            self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.gap = [], False
        self.blank |= blank

    def done(self) -> list[str]:
        self.end()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def _rows(table: Node) -> tuple[list[tuple[Node, list[Node]]], list[Node]]:
    """(row group, cells) by row, and what stands in a table without being part of its grid."""
    rows, rest = [], []
    for child in table.children:
        if isinstance(child, str):
            if child.strip():
                rest.append(child)
        elif not _visible(child):
            continue
        elif child.name == "tr":
            rows.append((table, [c for c in child.children if isinstance(c, Node) and c.name in ("td", "th") and _visible(c)]))
            rest.extend(c for c in child.children if not (isinstance(c, Node) and c.name in ("td", "th")) and not (isinstance(c, str) and not c.strip()))
        elif child.name in ("thead", "tbody", "tfoot"):
            inner, other = _rows(child)
            rows += inner
            rest += other
        elif child.name in ("td", "th"):
            rows.append((table, [child]))
        elif child.name not in ("col", "colgroup"):
            rest.append(child)
    return rows, rest


def _span(cell: Node, name: str, most: int) -> int:
    given = cell.attrs.get(name, "1").strip()
    if not (given.isascii() and given.isdigit()):
        return 1
    return min(int(given.lstrip("0")[:9] or 0), most)


def _grid(rows: list[tuple[Node, list[Node]]]) -> list[tuple[dict[int, Node], int]]:
    """(cells by their first column, width) of every row. Spans are kept as stretches of columns, so a wide one costs no more."""
    grid: list[tuple[dict[int, Node], int]] = []
    taken: list[tuple[int, int, int]] = []  # (first column, end, first row below the span), in order
    group, last = None, 0
    for number, (own, cells) in enumerate(rows):
        if own is not group:  # cells do not span beyond their row group
            taken, group, last = [], own, number
            while last < len(rows) and rows[last][0] is own:
                last += 1
        line, at, met, ahead = {}, 0, 0, []
        for cell in cells:
            while met < len(taken) and taken[met][0] <= at:
                at = max(at, taken[met][1])
                met += 1
            across, down = max(1, _span(cell, "colspan", 1000)), _span(cell, "rowspan", 65534)
            line[at] = cell
            if down != 1:
                ahead.append((at, at + across, min(number + down, last) if down else last))
            at += across
        while met < len(taken) and taken[met][0] <= at:
            at = max(at, taken[met][1])
            met += 1
        grid.append((line, at))
        taken = _joined(sorted([t for t in taken if t[2] > number + 1] + [t for t in ahead if t[2] > number + 1]))
    return grid


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring stretches that end with one row as one."""
    out: list[tuple[int, int, int]] = []
    for first, end, below in spans:
        if out and out[-1][1] >= first and out[-1][2] == below:
            out[-1] = (out[-1][0], max(end, out[-1][1]), below)
        else:
            out.append((first, end, below))
    return out


def _fixed(node: Node) -> bool:
    """Whether the lines of a cell must stay as they are."""
    return any(isinstance(c, Node) and (c.name in ("table", "pre", "textarea") or _fixed(c)) for c in node.children)


def _wrapped(line: str, width: int) -> list[str]:
    """``line`` in pieces of ``width`` characters, or one word if that is longer."""
    out, at = [], 0
    while len(line) - at > width:
        cut = line.rfind(" ", at, at + width + 1)
        if cut <= at or line[at:cut].isspace():
            cut = line.find(" ", at + width)
        if cut < 0:
            break
        out.append(line[at:cut].rstrip(" "))
        while cut < len(line) and line[cut] == " ":
            cut += 1
        at = cut
    return [*out, line[at:]]


def _table(node: Node, out: Layout) -> None:
    rows, rest = _rows(node)
    for child in rest:  # captions and misplaced content come first
        _render(child, out)
    out.end()
    placed = [({c: (cell, _lines(cell)) for c, cell in line.items()}, width) for line, width in _grid(rows)]
    # columns without visible text in any row take no place
    shown = sorted({c for line, _ in placed for c, (_, lines) in line.items() if any(lines)})
    count, widths = len(shown), [0] * len(shown)
    number = {c: k for k, c in enumerate(shown)}
    cells, grid = [], []
    for line, width in placed:
        inside = bisect_left(shown, width)
        cells.append({number[c]: cell for c, (cell, _) in line.items() if c in number})
        grid.append([[] for _ in range(inside)])
        for c, (_, lines) in line.items():
            if c in number:
                grid[-1][number[c]] = lines
                widths[number[c]] = max(widths[number[c]], max(map(len, lines), default=0))
    if sum(widths) + 3 * count > WIDEST:
        most = NARROWEST
        while most < WIDEST and sum(min(w, most + 1) for w in widths) + 3 * count <= WIDEST:
            most += 1
        for k, row in enumerate(grid):
            for c, lines in enumerate(row):
                if c < count - 1 and any(len(x) > most for x in lines) and not _fixed(cells[k][c]):
                    row[c] = [piece for x in lines for piece in _wrapped(x, most)]
        widths = [min(w, most) for w in widths]
    for row in grid:
        for parts in zip_longest(*row, fillvalue=""):
            text = " | ".join(p.ljust(w) for p, w in zip(parts[:-1], widths)) + (" | " if len(parts) > 1 else "") + parts[-1]
            if text.strip(" |"):
                out.word(text.rstrip(" "), keep=True)
                out.end()


def _lines(node: Node) -> list[str]:
    inner = Layout()
    for child in node.children:
        _render(child, inner)
    return inner.done()


def _drawing(node: Node, out: Layout, keep: bool, depth: int) -> None:
    """The text of a drawing; each of its labels is a word of its own."""
    for child in node.children:
        if isinstance(child, str) or not _visible(child) or child.name in SVG_UNSEEN:
            continue
        if child.name in SVG_TEXT:
            out.word(" ")
            for inner in child.children:
                _render(inner, out, keep, depth)
            out.word(" ")
        else:
            _drawing(child, out, keep, depth)


def _render(node: Node | str, out: Layout, keep: bool = False, depth: int = 0) -> None:
    if isinstance(node, str):
        out.word(node, keep)
        return
    if not _visible(node):
        return
    name = node.name
    if name == "br":
        out.end(force=True)
        return
    if name == "hr":
        out.end(blank=True)
        return
    if name == "img" or name == "input":
        shown = node.attrs.get("alt" if name == "img" else "value", "")
        if shown and node.attrs.get("type", "text").lower() not in ("checkbox", "radio", "image", "file"):
            out.word(shown)
        return
    if name == "svg":
        _drawing(node, out, keep, depth)
        return
    block = name in BLOCK
    if block:
        out.end(blank=name in SPACED and not (name in ("ul", "ol") and depth))
    if name == "table":
        _table(node, out)
    elif name in ("ul", "ol", "menu"):
        first = node.attrs.get("start", "1")
        number = int(first) if re.fullmatch(r"-?[0-9]{1,9}", first) else 1
        for child in node.children:
            if isinstance(child, Node) and child.name == "li" and _visible(child):
                out.end()
                out.marks = "  " * depth + (f"{number}. " if name == "ol" else "- ")
                number += 1
                for inner in child.children:
                    _render(inner, out, keep, depth + 1)
                out.end()
                out.marks = ""
            else:
                _render(child, out, keep, depth)
    else:
        for child in node.children:
            _render(child, out, keep or name in ("pre", "textarea"), depth)
    if block:
        out.end(blank=name in SPACED and not (name in ("ul", "ol") and depth))


def page_text(page: str) -> str:
    out = Layout()
    _render(build(page.replace("\x00", "")), out)
    return "\n".join(out.done())


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Rows of ``pages`` without ``html``, with their visible text in ``out`` (which replaces a column so named)."""
    keep = [c for c in pages.columns if c not in (html, out)]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(out, T.StringType())])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if p is None else page_text(p) for p in batch.column(batch.schema.get_field_index(html)).to_pylist()]
        return with_columns(batch, keep, {out: pa.array(texts, pa.string())})

    return pages.select(*keep, F.col(html).cast("string").alias(html)).mapInArrow(by_piece(fn, html), schema)
