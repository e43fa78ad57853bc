"""Operator 8: the visible text of pages, laid out.

A small tree builder closes what HTML lets authors leave open (paragraphs, list items, table cells, options), skips what a
browser does not show, and keeps going on any markup. The renderer then writes blocks on lines of their own, with a blank
line between paragraphs, list items with their markers, preformatted text as it is, and tables with aligned columns. Cells
stand on a grid: one that spans columns or rows keeps its places, and what begins behind it in any row is aligned behind it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Generator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import replaced, table

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style template noscript iframe object svg canvas audio video select datalist dialog title".split())
#: Blocks with a blank line before and after, and blocks on lines of their own only.
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
PLAIN = set(
    "address article aside body center dd details div dt fieldset figcaption footer form header hr html legend li main nav "
    "section summary caption thead tbody tfoot tr".split()
)
BLOCK = SPACED | PLAIN
#: What the start of an element closes, and the elements that it cannot close across.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
#: Blocks that an end tag of something outside them does not close.
WALLS = {"table", "td", "th", "caption"}
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.IGNORECASE)
#: Most columns and rows that a cell may span, as browsers have it.
MAX_SPAN = {"colspan": 1000, "rowspan": 65534}
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: What indentation and padding may add to a page: so many characters, or so many times its markup. A table beyond that pads
#: its columns to 40 only, a list or quotation beyond that is indented by its innermost 100 levels; no text is left out.
ROOM = 1 << 20
ROOM_X = 8


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict
    children: list = field(default_factory=list)
    #: Takes its place without being seen, by its own or an outer visibility.
    unseen: bool = False

    @property
    def visible(self) -> bool:
        if self.tag in HIDDEN or "hidden" in self.attrs or self.attrs.get("aria-hidden") == "true":
            return False
        return not _NOT_SHOWN.search(self.attrs.get("style") or "")


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("html", {})]
        #: Of each tag, the places of its open elements.
        self.places: dict[str, list[int]] = {}

    def _pop_to(self, length: int) -> None:
        for node in self.open[length:]:
            self.places[node.tag].pop()
        del self.open[length:]

    def _innermost(self, tags: set[str]) -> int:
        return max((found[-1] for t in tags if (found := self.places.get(t))), default=0)

    def _last(self, tags: set[str], walls: set[str]) -> int:
        """Place of the innermost open element of the tags; 0 if there is none or a wall is nearer."""
        at = self._innermost(tags)
        return at if at and at >= self._innermost(walls) else 0

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and len(self.open) > 1 and tag != "body":
            return
        if tag in CLOSES:
            closed, walls = CLOSES[tag]
            while at := self._last(closed, walls):
                self._pop_to(at)
            if tag in ("td", "th") and not self._last({"tr"}, {"table"}):
                self._push(Node("tr", {}, unseen=self.open[-1].unseen))
        elif tag in BLOCK and (at := self._last({"p"}, WALLS)):
            self._pop_to(at)
        if tag == "body" and (at := self._last({"head"}, set())):
            self._pop_to(at)
        node = Node(tag, dict(attrs))
        said = _VISIBILITY.findall(node.attrs.get("style") or "")
        node.unseen = said[-1].lower() != "visible" if said else self.open[-1].unseen
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.open) > 1 and self.open[-1].tag == tag and tag not in BLOCK:
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        walls = set() if tag in WALLS or tag in ("tr", "tbody", "thead", "tfoot") else WALLS
        if tag == "p" and not self._last({"p"}, WALLS):
            self.open[-1].children.append(Node("p", {}))
        elif at := self._last({tag}, walls):
            self._pop_to(at)

    def handle_data(self, data):
        if not self.open[-1].unseen:
            self.open[-1].children.append(data)


@dataclass(eq=False)
class Indented:
    """Lines behind a prefix, the first and the later ones; the last line is not empty."""

    lines: list[str | Indented]
    first: str
    later: str


class Room:
    """What indentation and padding may still add to the page."""

    def __init__(self, size: int):
        self.left = max(ROOM, ROOM_X * size)

    def take(self, n: int) -> bool:
        if n > self.left:
            return False
        self.left -= n
        return True


def _flat(lines: list[str | Indented], room: Room) -> list[str]:
    """The lines with their prefixes."""
    if not any(isinstance(x, Indented) for x in lines):
        return lines
    wanted, stack = 0, [(iter(lines), 0)]
    while stack:
        inside, width = stack[-1]
        for x in inside:
            if isinstance(x, Indented):
                stack.append((iter(x.lines), width + len(x.first)))
                break
            wanted += width
        else:
            stack.pop()
    levels = 0 if room.take(wanted) else -100
    out: list[str] = []
    walk, around = [(iter(lines), False)], []
    while walk:
        inside, prefixed = walk[-1]
        for x in inside:
            if isinstance(x, Indented):
                walk.append((iter(x.lines), bool(x.first)))
                if x.first:
                    around.append((x, len(out)))
                break
            out.append(("".join(a.first if at == len(out) else a.later for a, at in around[levels:]) + x).rstrip())
        else:
            walk.pop()
            if prefixed:
                around.pop()
    return out


class Lines:
    """Text under layout: words collapse to one blank, blocks start lines, a gap is one empty line."""

    def __init__(self, room: Room):
        self.room = room
        self.done: list[str | Indented] = []
        self.now: list[str] = []
        self.gap = False

    def text(self, data: str) -> None:
        data = _SPACE.sub(" ", data)
        if data.startswith(" ") and (not self.now or self.now[-1].endswith((" ", "\n"))):
            data = data[1:]
        if data:
            self._space()
            self.now.append(data)

    def _space(self) -> None:
        if self.gap and self.done:
            self.done.append("")
        self.gap = False

    def line(self) -> None:
        if self.now:
            self.done += [x.rstrip() for x in "".join(self.now).split("\n")]
            self.now = []

    def block(self, spaced: bool) -> None:
        self.line()
        self.gap |= spaced

    def add(self, lines: list[str | Indented]) -> None:
        self.line()
        if lines:
            self._space()
            self.done += [x.rstrip() if isinstance(x, str) else x for x in lines]

    def indent(self, lines: list[str | Indented], prefix: str, later: str) -> None:
        self.add([Indented(lines, prefix, later)] if lines else [])

    def result(self) -> list[str | Indented]:
        self.line()
        return self.done


def _run(step: Generator):
    """The value of a generator that yields the generators it needs the values of: recursion without the interpreter's stack."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _raw(node: Node) -> str:
    out: list[str] = []
    stack = [iter(node.children)]
    while stack:
        for c in stack[-1]:
            if isinstance(c, str):
                out.append(c)
            elif c.tag == "br":
                out.append("\n")
            elif c.visible:
                stack.append(iter(c.children))
                break
        else:
            stack.pop()
    return "".join(out)


def _inside(node: Node, room: Room) -> Generator:
    out = Lines(room)
    yield _flow(node, out)
    lines = out.result()
    while lines and not lines[-1]:
        lines.pop()
    return lines


def _flow(node: Node, out: Lines) -> Generator:
    for c in node.children:
        if isinstance(c, str):
            out.text(c)
        elif c.visible:
            yield _element(c, out)


def _element(node: Node, out: Lines) -> Generator:
    tag = node.tag
    if tag == "br":
        out.line() if out.now else out.add([""])
    elif tag == "hr":
        out.add([] if node.unseen else ["---"])
    elif tag == "img":
        if node.attrs.get("alt") and not node.unseen:
            out.text(node.attrs["alt"])
    elif tag in ("ul", "ol"):
        yield _list(node, out)
    elif tag == "table":
        out.block(True)
        out.add((yield _table(node, out.room)))
        out.block(True)
    elif tag == "pre":
        out.block(True)
        raw = _raw(node).strip("\n")
        out.add([] if node.unseen and not raw else raw.split("\n"))
        out.block(True)
    elif tag == "dd":
        out.indent((yield _inside(node, out.room)), "  ", "  ")
    elif tag == "blockquote":
        out.block(True)
        out.indent((yield _inside(node, out.room)), "> ", "> ")
        out.block(True)
    elif tag in BLOCK:
        out.block(tag in SPACED)
        yield _flow(node, out)
        out.block(tag in SPACED)
    else:
        yield _flow(node, out)


def _list(node: Node, out: Lines) -> Generator:
    number = node.attrs.get("start") or ""
    count = int(number) if re.fullmatch(r"-?[0-9]{1,9}", number, re.ASCII) else 1
    out.block(True)
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                out.text(c)
        elif c.visible and c.tag == "li":
            mark = f"{count}. " if node.tag == "ol" else "- "
            lines = yield _inside(c, out.room)
            if c.unseen:
                mark = " " * len(mark)
            out.indent(lines or ([] if c.unseen else [""]), mark, " " * len(mark))
            count += 1
        elif c.visible:
            yield _element(c, out)
    out.block(True)


def _span(cell: Node, name: str) -> int:
    """The number of columns or rows; 0 rows: to the end of the row group."""
    value = re.match(r"[ \t\n\r\f]*\+?([0-9]{1,9})", cell.attrs.get(name) or "", re.ASCII)
    n = min(int(value[1]), MAX_SPAN[name]) if value else 1
    return n if n or name == "rowspan" else 1


class Grid:
    """Cells of a table as (first column, column behind the last, text), row by row."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, str]]] = []
        #: Columns that cells of earlier rows still hold: (first, behind the last, first row without it), in order.
        self.held: list[tuple[int, int, float]] = []
        self.at = 0

    def group(self) -> None:
        """A new row group: no cell reaches into it."""
        self.held = []

    def add(self, cells: list[tuple[int, int, str]], shown: bool = True) -> None:
        """A row of cells given as (columns, rows, text); one that is not shown holds its places only."""
        row, mine, at, held = [], [], 0, iter(self.held)
        taken = next(held, None)
        for columns, rows, text in cells:
            while taken and taken[0] <= at:
                at = max(at, taken[1])
                taken = next(held, None)
            # a cell may reach over what an earlier row holds, as it does in a browser
            row.append((at, at + columns, text))
            if rows != 1:
                mine.append((at, at + columns, self.at + rows if rows else float("inf")))
            at += columns
        self.at += 1
        if mine or any(end <= self.at for _, _, end in self.held):
            merged: list[tuple[int, int, float]] = []
            for a, b, end in sorted([x for x in self.held if x[2] > self.at] + mine):
                if merged and merged[-1][1] == a and merged[-1][2] == end:
                    merged[-1] = (merged[-1][0], b, end)
                else:
                    merged.append((a, b, end))
            self.held = merged
        if shown and row:
            self.rows.append(row)

    def places(self) -> dict[int, int]:
        """The character at which each column that a cell begins in starts: two blanks behind all cells before it."""
        starts = sorted({a for row in self.rows for a, _, _ in row})
        longest: dict[tuple[int, int], int] = {}
        for row in self.rows:
            for a, b, text in row:
                if (to := bisect_left(starts, b)) < len(starts):
                    longest[(to, a)] = max(longest.get((to, a), 0), len(text))
        behind: dict[int, list[tuple[int, int]]] = {}
        for (to, a), n in longest.items():
            behind.setdefault(to, []).append((a, n))
        place: dict[int, int] = {}
        for i, start in enumerate(starts):
            least = place[starts[i - 1]] + 2 if i else 0
            place[start] = max([least, *(place[a] + n + 2 for a, n in behind.get(i, ()))])
        return place

    def lines(self, room: Room) -> list[str]:
        place = self.places()
        if not room.take(sum(place[row[-1][0]] - sum(len(t) for _, _, t in row[:-1]) for row in self.rows)):
            # padding up to one very long cell in every row would square the size
            short = Grid()
            short.rows = [[(a, b, t[:40]) for a, b, t in row] for row in self.rows]
            place = short.places()
        out = []
        for row in self.rows:
            line, size = [], 0
            for a, _, text in row:
                gap = max(place[a] - size, 2 if size else 0)
                line += [" " * gap, text]
                size += gap + len(text)
            out.append("".join(line).rstrip())
        return out


def _table(node: Node, room: Room) -> Generator:
    """Cells of a column start at the same place; a cell of several lines is joined to one."""
    lead: list[str | Indented] = []
    grid = Grid()

    def joined(part: Node) -> Generator:
        return " ".join(x for x in _flat((yield _inside(part, room)), room) if x)

    def collect(part: Node) -> Generator:
        for c in part.children:
            if isinstance(c, str):
                if c.strip():
                    lead.append(_SPACE.sub(" ", c).strip())
            elif not c.visible:
                continue
            elif c.tag == "tr":
                row, stray = [], []
                for x in c.children:
                    if isinstance(x, str):
                        stray += [x] if x.strip() else []
                    elif x.visible and x.tag in ("td", "th"):
                        row.append((_span(x, "colspan"), _span(x, "rowspan"), (yield joined(x))))
                    else:
                        stray.append(x)
                if stray and (other := (yield joined(Node("div", {}, stray)))):
                    row.append((1, 1, other))
                grid.add(row, not c.unseen or any(text for _, _, text in row))
            elif c.tag in ("thead", "tbody", "tfoot"):
                grid.group()
                yield collect(c)
                grid.group()
            elif lines := (yield _inside(Node("div", {}, [c]), room)):
                lead.append(Indented(lines, "", ""))

    yield collect(node)
    return lead + grid.lines(room)


def render(html: str | None) -> str:
    """Visible text of a page; empty for a null or empty page."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    room = Room(len(html or ""))
    return "\n".join(_flat(_run(_inside(builder.open[0], room)), room)).strip("\n")


@F.arrow_udf(T.StringType())
def _render(html: pa.Array) -> pa.Array:
    return pa.array([render(h) for h in html.to_pylist()], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with a column ``text`` (an input column of that name goes).

    Null and empty pages have an empty text. Any markup gives a text: unclosed elements end with the page, unmatched end
    tags are ignored, elements may be nested at any depth. Rows are judged alone.
    """
    return replaced(pages, text=_render("html"))


def query(spark, sf_dir):
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_html_text": query}
ORACLE = {}
