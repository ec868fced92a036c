"""HTML extraction by layout-aware rendering.

A tree builder with implied tags turns markup into elements; visibility rules
leave out what a browser would not show; a renderer lays blocks out as lines
with paragraph spacing, list markers, and table cells in aligned columns. Time
and output grow in proportion to the page, whatever its nesting.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body

# Fixed values of the HTML standard: element classes by name, largest spans.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe object audio video canvas datalist noembed noframes area base link meta param source track rp".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre hr figure fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = MARGIN | frozenset(
    "html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li listing main nav option search section summary optgroup tr td th thead tbody tfoot caption".split()
)
ENDS_P = BLOCK - frozenset("html body tr td th thead tbody tfoot caption option optgroup dialog legend".split()) | {"dialog"}
#: A start tag closes these open elements, looking no further out than the barrier.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
#: Where a start tag of a table's structure belongs: what is open inside of the nearest of these ends first.
CONTEXT = dict.fromkeys(("caption", "colgroup", "col", "thead", "tbody", "tfoot"), {"table"})
CONTEXT |= {"tr": {"table", "thead", "tbody", "tfoot"}} | dict.fromkeys(("td", "th"), {"table", "thead", "tbody", "tfoot", "tr"})
#: Directly in these only a table's structure and INSIDE may stand; a browser shows anything else before the table.
TABLE = frozenset("table thead tbody tfoot tr".split())
INSIDE = frozenset(CONTEXT) | frozenset("style script template form".split())
CELL = frozenset("td th caption template".split())
#: End tags do not reach beyond these.
SCOPE = frozenset("table td th caption html template".split())
NO_BARRIER = frozenset("table td th caption html template tr thead tbody tfoot body".split())
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
# How the text is laid out; none of these loses any of it. The columns of a table share so many characters, and its
# cells are wrapped to their share: no less than their longest word, or LONG where a word is longer, and no less than
# LEAST where they have as much. A table in so many others has its cells one below the other; row spans are followed in
# the first COLUMNS columns; indentation stops at INDENT.
CELL_GAP = "  "
WIDTH, LEAST, LONG, COLUMNS, NESTED, INDENT = 240, 16, 40, 1000, 8, 40

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for m in _ATTR.finditer(self.attrs):
            found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return found


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", tag, attributes), ("end", tag, "") and
    ("raw", tag, content) after the start of an element of raw text.

    A quoted attribute may hold ">". Where a quote is never closed, that tag and
    those after it end at their first ">"; a "<" that no ">" follows is text.
    So no part of the page is read more than twice.
    """
    at, n, quotes = 0, len(html), True
    while at < n:
        lt = html.find("<", at)
        if lt != at:
            yield "text", html[at : lt if lt >= 0 else n], ""
            if lt < 0:
                return
        if html.startswith("<!--", lt):
            m = None if html.startswith((">", "->"), lt + 4) else _COMMENT_END.search(html, lt + 4)
            at = html.index(">", lt) + 1 if html.startswith((">", "->"), lt + 4) else m.end() if m else n
            continue
        gt = html.find(">", lt)
        if gt < 0:
            yield "text", html[lt:], ""
            return
        if html.startswith(("<!", "<?"), lt):
            at = gt + 1
            continue
        tag = _TAG.match(html, lt + 1)
        if tag is None:
            yield "text", "<", ""
            at = lt + 1
            continue
        if quotes:
            m = _QUOTED.match(html, tag.end())
            quotes = m is not None
            gt = m.end() - 1 if m else gt
        name, at = tag[2].lower(), gt + 1
        if tag[1]:
            yield "end", name, ""
            continue
        yield "start", name, html[tag.end() : gt]
        if name in RAW:
            found = _RAW_END[name].search(html, at)
            end = found.start() if found else n
            yield "raw", name, html[at:end]
            close = html.find(">", end)
            at = n if close < 0 else close + 1


class Tree:
    """The element tree while it is built: the open elements, and for each tag
    where in them it stands, so that no look outwards walks over them."""

    def __init__(self) -> None:
        self.root = Node("#root")
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)

    def nearest(self, tags: Iterable[str]) -> int:
        """The innermost open element of ``tags``; 0 if none is open."""
        found = 0
        for t in tags:
            places = self.at.get(t)
            if places and places[-1] > found:
                found = places[-1]
        return found

    def cut(self, i: int) -> None:
        while len(self.open) > i:
            self.at[self.open.pop().tag].pop()

    def close(self, tags: Iterable[str], barrier: Iterable[str]) -> None:
        i = self.nearest(tags)
        wall = i and self.nearest(barrier)
        while i > wall:
            self.cut(i)
            i = self.nearest(tags)

    def add(self, child: Node | str) -> None:
        """Hangs a child on the open element or, where a table allows none, before
        the table (foster parenting)."""
        if self.open[-1].tag in TABLE and (isinstance(child, str) or child.tag not in INSIDE):
            i = self.nearest(("table",))
            if i > self.nearest(CELL):
                around = self.open[i - 1].children
                around.insert(len(around) - 1, child)
                return
        self.open[-1].children.append(child)

    def text(self, text: str) -> None:
        if _SPACE.fullmatch(text):
            self.open[-1].children.append(text)
            return
        if self.open[-1].tag == "colgroup":
            self.cut(len(self.open) - 1)
        self.add(text)

    def start(self, tag: str, attrs: str) -> bool:
        """Whether the element is open now."""
        if self.open[-1].tag == "colgroup" and tag not in ("col", "template"):
            self.cut(len(self.open) - 1)
        if tag in ENDS_P:
            self.close(("p",), SCOPE)
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        if tag in CONTEXT and self.open[-1].tag != "colgroup":
            i = self.nearest(CONTEXT[tag])
            if i > self.nearest(CELL):
                self.cut(i + 1)
        if tag == "table":  # straight in a table it ends that one
            self.close(("table",), CELL)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.cut(len(self.open) - 1)
        if tag in ("body", "frameset"):
            self.close(("head",), ())
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.start("tr", "")
        if tag in BLOCK and self.open[-1].tag == "head":
            self.cut(len(self.open) - 1)
        node = Node(tag, attrs)
        straight = tag == "form" and self.open[-1].tag in TABLE
        self.add(node)
        if tag in VOID or straight or (attrs.endswith("/") and tag in ("svg", "path", "g", "use", "rect", "circle", "line")):
            return False
        self.at[tag].append(len(self.open))
        self.open.append(node)
        return True

    def end(self, tag: str) -> None:
        if tag == "br":
            self.add(Node("br"))
            return
        i = self.nearest((tag,))
        if i > (0 if tag in NO_BARRIER else self.nearest(SCOPE)):
            self.cut(i)
        elif tag == "p":
            self.add(Node("p"))


def parse(html: str) -> Node:
    """The element tree; children are nodes or text. Never fails."""
    tree = Tree()
    opened = False
    for kind, a, b in tokens(html):
        if kind == "text":
            tree.text(unescape(a))
        elif kind == "start":
            opened = tree.start(a, b)
        elif kind == "end":
            tree.end(a)
        elif opened:
            tree.open[-1].children.append(unescape(b) if a in ("textarea", "title") else b)
            tree.cut(len(tree.open) - 1)
    return tree.root


class Fixed(str):
    """A line that is not wrapped: of a table, or of preformatted text."""

    __slots__ = ()


class Flow:
    """Lines of one formatting context, with collapsed white space, margins,
    indentation and the mark that a list item puts before its first line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0  # blank lines due before the next line
        self.space = False
        self.line: type[str] = str  # or Fixed, of the line at hand
        self.indent = ""
        self.mark: str | None = None
        self.fresh = True  # no line yet in the innermost container, whose first margin falls away

    def text(self, s: str) -> None:
        for i, word in enumerate(_SPACE.split(s)):
            if i:
                self.space = True
            if word:
                if self.space and self.parts:
                    self.parts.append(" ")
                self.parts.append(word)
                self.space = False

    def verbatim(self, s: str) -> None:
        first, *rest = s.split("\n")
        self.line = Fixed
        if first:
            self.parts.append(first.rstrip("\r"))
        for line in rest:
            self.newline(True)
            self.line = Fixed
            if line:
                self.parts.append(line.rstrip("\r"))

    def newline(self, force: bool = False) -> None:
        if self.parts or force:
            self.add([self.line("".join(self.parts))])
        self.parts, self.space, self.line = [], False, str

    def block(self, gap: int) -> None:
        self.newline()
        if not self.fresh:
            self.gap = max(self.gap, gap)

    def add(self, lines: list[str]) -> None:
        if not lines:
            return
        self.lines.extend([""] * self.gap)
        self.gap, self.fresh = 0, False
        for line in lines:
            before, self.mark = self.indent if self.mark is None else self.mark, None
            self.lines.append(type(line)((before + line).rstrip()))

    def enter(self, indent: str, mark: str | None = None) -> tuple:
        """Begins an indented container; ``leave`` takes what this returns."""
        state = (self.indent, self.fresh, len(self.lines))
        if mark is not None:
            self.mark = (self.indent if self.mark is None else self.mark) + mark
        elif self.mark is not None:
            self.mark += indent
        if len(self.indent) + len(indent) <= INDENT:
            self.indent += indent
        self.fresh = True
        return state

    def leave(self, state: tuple, marked: bool = False) -> None:
        self.newline()
        if marked and self.mark is not None:
            self.add([""])
        self.indent, fresh, n = state
        self.gap, self.fresh = 0, fresh and n == len(self.lines)

    def close(self) -> list[str]:
        self.newline()
        return self.lines


_INTEGER = re.compile(r"-?\d{1,9}")
_ROMAN = tuple(zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()))


def numbered(n: int, kind: str) -> str:
    """A list item's number as ``type`` asks for it: 1, a, A, i or I; what the
    letters cannot write is written in digits."""
    low = ""
    if kind in ("a", "A"):
        left = n
        while left > 0:
            left, digit = divmod(left - 1, 26)
            low = chr(97 + digit) + low
    elif kind in ("i", "I") and 0 < n < 4000:
        left = n
        for value, letters in _ROMAN:
            low += letters * (left // value)
            left %= value
    return (low.upper() if kind.isupper() else low) or str(n)


def _numbering(node: Node) -> list:
    """[type, next number, step] of a list; the type of one without numbers is empty."""
    if node.tag != "ol":
        return ["", 1, 1]
    a = node.attributes() if node.attrs else {}
    step = -1 if "reversed" in a else 1
    start = a.get("start", "")
    first = 1 if step == 1 else sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
    kind = a.get("type", "1")
    return [kind if kind in ("a", "A", "i", "I") else "1", int(start) if _INTEGER.fullmatch(start) else first, step]


def _mark(item: Node, numbering: list) -> str:
    """What stands before a list item; counts on."""
    kind, n, step = numbering
    value = item.attributes().get("value", "") if kind and item.attrs else ""
    n = int(value) if _INTEGER.fullmatch(value) else n
    numbering[1] = n + step
    return f"{numbered(n, kind)}. " if kind else "- "


_HIDES = re.compile(r"hidden|style|open|details|dialog", re.I)


def visible(node: Node, shown: bool) -> tuple[bool, bool]:
    """(laid out, its text shown): display takes the whole subtree away, while
    a descendant may turn visibility on again."""
    if node.tag in HIDDEN:
        return False, False
    if not node.attrs or not _HIDES.search(node.attrs):
        return node.tag != "dialog", shown
    a = node.attributes()
    style = {k.strip(): v.partition("!")[0].strip() for k, _, v in (x.partition(":") for x in a.get("style", "").lower().split(";"))}
    hidden = "hidden" in a or style.get("display") == "none" or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden")
    if hidden:
        return False, False
    how = style.get("visibility")
    return True, False if how in ("hidden", "collapse") else shown or how == "visible"


def shown_children(node: Node) -> list:
    """What of a node's children is laid out: closed details show their summary only."""
    if node.tag != "details" or "open" in node.attributes():
        return node.children
    return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]


def lay(node: Node, flow: Flow, shown: bool = True, tables: int = 0) -> None:
    """Lays out what is in a node. The elements on the way down are held in a
    list of frames: their children to come, what holds for them, what is due
    when they end, and in a list its numbering."""
    frames: list[tuple] = [(iter(shown_children(node)), shown, False, 0, None, None)]
    while frames:
        children, shown, pre, depth, leave, listed = frames[-1]
        child = next(children, None)
        if child is None:
            frames.pop()
            if leave is not None:
                leave()
            continue
        if isinstance(child, str):
            if shown:
                flow.verbatim(child) if pre else flow.text(child)
            continue
        laid, show = visible(child, shown)
        if not laid:
            continue
        tag, leave, list_now = child.tag, None, None
        if tag == "br":
            flow.newline(True)
        elif tag == "hr":
            flow.block(1)
        elif tag == "table" and tables < NESTED:
            flow.block(1)
            flow.add(_table(child, show, tables + 1))
            flow.block(1)
            continue
        elif tag == "li" and listed is not None:
            mark = _mark(child, listed)
            flow.block(0)
            leave = _leaver(flow, flow.enter(" " * len(mark), mark), True, None)
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.block(int(depth == 0))
            list_now = _numbering(child)
            leave = _blocker(flow, int(depth == 0))
            pre, depth = False, depth + 1
        elif tag in ("blockquote", "dd"):
            gap = int(tag == "blockquote")
            flow.block(gap)
            leave = _leaver(flow, flow.enter("  "), False, gap)
        elif tag in BLOCK:
            gap = int(tag in MARGIN)
            flow.block(gap)
            leave = _blocker(flow, gap)
            pre = pre or tag in ("pre", "listing")
        elif tag == "textarea":
            pre = True
        elif tag == "input" and show and child.attrs:
            a = child.attributes()
            if a.get("type", "").lower() in ("button", "submit", "reset"):
                flow.text(a.get("value", ""))
        if child.children:
            frames.append((iter(shown_children(child)), show, pre, depth, leave, list_now))
        elif leave is not None:
            leave()


def _blocker(flow: Flow, gap: int):
    return lambda: flow.block(gap)


def _leaver(flow: Flow, state: tuple, marked: bool, gap: int | None):
    def leave() -> None:
        flow.leave(state, marked)
        if gap is not None:
            flow.block(gap)

    return leave


def _rows(node: Node, shown: bool) -> Iterator[tuple[Node, bool]]:
    for child in node.children:
        if isinstance(child, Node):
            laid, show = visible(child, shown)
            if laid and child.tag in ("tr", "caption"):
                yield child, show
            elif laid and child.tag in ("thead", "tbody", "tfoot"):
                yield from ((row, seen) for row, seen in _rows(child, show))


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attributes().get(name, "") if cell.attrs else ""
    return min(most, int(value)) if re.fullmatch(r"[1-9]\d{0,8}", value) else 1


def _joined(below: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], int | float]:
    """The columns taken as disjoint stretches, and the row in which the first of them is free."""
    out: list[tuple[int, int]] = []
    for first, stop, _ in sorted(below):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((first, stop))
    return out, min((x[2] for x in below), default=math.inf)


def _wrapped(line: str, width: int) -> list[str]:
    """``line`` broken at its spaces into lines of at most ``width`` characters;
    a longer word has a line of its own, inner spaces and indentation stay."""
    if len(line) <= width or isinstance(line, Fixed):
        return [line]
    body = len(line) - len(line.lstrip(" "))
    out, at, before, later = [], 0, "", " " * min(body, width // 2)
    while len(before) + len(line) - at > width:
        full = at + width - len(before)
        cut = line.rfind(" ", body + 1, full + 1)
        cut = cut if cut >= 0 else line.find(" ", max(full, body))
        if cut < 0:
            break
        out.append((before + line[at:cut]).rstrip())
        while line[cut] == " ":  # lines have no space at their end
            cut += 1
        at, body, before = cut, cut, later
    return [*out, before + line[at:]]


def _needs(line: str) -> tuple[int, int]:
    """The least width that a line should have, and the most that it can use."""
    if isinstance(line, Fixed):  # it may reach beyond its column, cells beside it then begin below
        return min(len(line), WIDTH // 2), min(len(line), WIDTH)
    longest = max(map(len, line.split(" ")))
    return max(min(longest, LONG), min(len(line), LEAST)), min(len(line), WIDTH) if longest <= WIDTH // 2 else LONG


def _bands(least: list[int], most: list[int]) -> tuple[list[int], list[int]]:
    """Columns that go side by side: the band and the width of each. A band takes
    columns while their least widths fit; what is left goes to those that can use
    it, in equal shares."""
    band, width, first, used = [], list(least), 0, 0
    for c, n in enumerate([*least, WIDTH]):
        if c > first and used + n + len(CELL_GAP) * (c - first) > WIDTH or c == len(least):
            left = WIDTH - used - len(CELL_GAP) * (c - first - 1)
            for i, k in enumerate(sorted(range(first, c), key=lambda k: most[k] - least[k])):
                more = max(0, min(most[k] - least[k], left // (c - first - i)))
                width[k], left = width[k] + more, left - more
            band += [band[-1] + 1 if band else 0] * (c - first)
            first, used = c, 0
        used += n
    return band, width


def _table(node: Node, shown: bool, tables: int) -> list[str]:
    """Cells in columns: each as wide as its widest line, spanned cells grow the
    last column they cover, cells below a row span stay in their column. Where
    that would be wider than WIDTH, cells are wrapped to their column's share of
    it; columns that do not fit side by side even so go on in a further band
    below, row by row."""
    head: list[str] = []
    grid: list[list[tuple[int, int, list[str]]]] = []
    below: list[tuple[int, int, int]] = []  # columns taken by cells of earlier rows: first, stop, first row without
    taken: list[tuple[int, int]] = []  # the same joined
    next_free: int | float = math.inf
    for row, show in _rows(node, shown):
        if row.tag == "caption":
            inner = Flow()
            lay(row, inner, show, tables)
            head.extend(inner.close())
            continue
        n = len(grid)
        if n >= next_free:
            below = [x for x in below if x[2] > n]
            taken, next_free = _joined(below)
        cells, col, k, grown = [], 0, 0, False
        for cell in row.children:
            if not isinstance(cell, Node) or cell.tag not in ("td", "th"):
                continue
            laid, seen = visible(cell, show)
            if not laid:
                continue
            while k < len(taken) and taken[k][0] <= col:
                col, k = max(col, taken[k][1]), k + 1
            inner = Flow()
            lay(cell, inner, seen, tables)
            wide, tall = _span(cell, "colspan", MAX_COLSPAN), _span(cell, "rowspan", MAX_ROWSPAN)
            cells.append((col, col + wide, inner.close()))
            if tall > 1 and col < COLUMNS:
                below.append((col, col + wide, n + tall))
                grown = True
            col += wide
        if grown:
            taken, next_free = _joined(below)
        grid.append(cells)

    # columns are where cells start; a cell covers those up to its end
    starts = sorted({col for cells in grid for col, _, _ in cells})
    if len(starts) == 1:
        return head + [line for cells in grid for _, _, lines in cells for line in lines]
    place = {col: i for i, col in enumerate(starts)}
    grid = [[(place[col], bisect_left(starts, stop), lines) for col, stop, lines in cells] for cells in grid]
    width = [0] * len(starts)
    for cells in grid:
        for i, j, lines in cells:
            if j == i + 1:
                width[i] = max(width[i], max(map(len, lines), default=0))
    fits = sum(width) + len(CELL_GAP) * len(width) <= WIDTH
    if fits:
        for cells in grid:
            for i, j, lines in cells:
                if j > i + 1:
                    have = sum(width[i:j]) + len(CELL_GAP) * (j - i - 1)
                    width[j - 1] += max(0, max(map(len, lines), default=0) - have)
        fits = sum(width) + len(CELL_GAP) * len(width) <= WIDTH
    band = [0] * len(starts)
    if not fits:
        least, most = [0] * len(starts), [0] * len(starts)
        for cells in grid:
            for i, j, lines in cells:
                for line in lines if j == i + 1 else ():
                    a, b = _needs(line)
                    least[i], most[i] = max(least[i], a), max(most[i], a, b)
        band, width = _bands(least, most)
    x = [0] * len(starts)
    for i in range(1, len(starts)):
        x[i] = x[i - 1] + width[i - 1] + len(CELL_GAP) if band[i] == band[i - 1] else 0

    out = list(head)
    for cells in grid:
        for _, side in groupby(cells, key=lambda c: band[c[0]]):
            side, row = list(side), []
            for n, (i, j, lines) in enumerate(side):
                if not fits:
                    stop = side[n + 1][0] if n + 1 < len(side) else bisect_right(band, band[i])
                    room = width[i] if j == i + 1 else x[min(j, stop) - 1] + width[min(j, stop) - 1] - x[i]
                    if j > i + 1 and n + 1 == len(side):  # nothing beside it
                        room = max(room, WIDTH - x[i])
                    lines = [part for line in lines for part in _wrapped(line, max(1, room))]
                row.append((x[i], lines))
            for k in range(max((len(lines) for _, lines in row), default=0)):
                line = ""
                for start, lines in row:
                    if k < len(lines) and lines[k]:
                        if line and len(line) + len(CELL_GAP) > start:  # a word wider than its column
                            out.append(Fixed(line.rstrip()))
                            line = ""
                        line = line.ljust(start) + lines[k]
                out.append(Fixed(line.rstrip()))
    return out


def render(html: str) -> str:
    """All visible text of a page."""
    flow = Flow()
    lay(parse(html), flow)
    return "\n".join(x.rstrip() for x in flow.close()).strip("\n")


def extract(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, text) for every row of ``pages``. Null and empty pages give an empty
    text, broken markup whatever text it shows; a very long page is one row's
    work, in time and memory in proportion to it; null ids stay, repeated rows
    render alike, an empty table gives none, other columns are ignored. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [render(raw.as_py().decode("utf-8", "replace")) for raw in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    src = pages.select(F.col(id).alias("id"), body(html).alias("raw"))
    out = src.mapInArrow(run, f"id {pages.schema[id].dataType.simpleString()}, text string")
    return out.select(F.col("id").alias(id), "text")
