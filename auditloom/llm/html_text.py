"""Visible text of HTML pages, by a tree and a layout.

The page is cut into tags and texts, a tree is built with the tags that HTML implies (an
open paragraph ends where a block begins, a list item where the next begins, a cell
without a row gets one), and the tree is laid out: hidden elements are left out, blocks
stand on lines of their own with the blank lines their kind has, list items get markers
and indents, and the cells of a table are padded to columns.

The work is linear in the page.  To that end a column starts ``MAX_OFFSET`` characters from the
margin at most, cells beyond ``MAX_COLUMNS`` columns are not moved by cells of other rows,
indents stop growing at ``MAX_INDENTS`` levels, and tables in ``MAX_TABLES`` tables are laid out
as lines, a cell each; no text is left out.

Defined results.  A null page has null text, an empty one an empty text.  Broken markup
never fails: unknown end tags are ignored, open elements end with the page, depth is
bounded by the page alone (no recursion).  Repeated rows get the same answer.  Other
columns are carried along, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of HTML, by what the elements do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = set(
    "head title script style template datalist iframe noembed noframes audio video canvas object "
    "meta link base area param source track col colgroup".split()
)
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p "
    "pre search section summary table tbody td tfoot th thead tr ul caption option optgroup xmp".split()
)
#: Blocks that stand apart from their neighbours by a blank line.
APART = set("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir xmp fieldset".split())
#: Blocks that end an open paragraph.
ENDS_PARAGRAPH = BLOCKS - set("body html tbody td tfoot th thead tr caption option optgroup legend".split())
#: An opening tag ends these open elements, looking no further than the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: An opening tag of these ends an open caption.
ENDS_CAPTION = set("caption col colgroup tbody td tfoot th thead tr".split())
#: Opening tags of these leave an open column group open.
IN_COLUMN_GROUP = {"col", "template"}
#: End tags look for their element no further than these.
SCOPE = {"table", "td", "th", "caption", "template"}
IN_HEAD = set("base link meta title style script noscript template head".split())
LISTS = {"ul", "ol", "menu", "dir"}
MAX_SPAN = 1000

#: An attribute as HTML's tokeniser reads it: a quote opens a run only where a value starts.
_NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
_EQUALS = r"[ \t\n\r\f]*+=[ \t\n\r\f]*+"
_BARE = r"[^ \t\n\r\f>\"'][^ \t\n\r\f>]*+"
_PIECE = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)"
    rf"(?P<attrs>(?:[ \t\n\r\f/]++|{_NAME}(?:{_EQUALS}(?:\"[^\"]*\"|'[^']*'|{_BARE}|(?=>))|(?!{_EQUALS})))*+)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<(?![A-Za-z!?/]))",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_EQUALS}(?:\"([^\"]*)\"|'([^']*)'|({_BARE}))?)?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_HIDES = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.IGNORECASE)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)


#: Bounds of the layout, see above.
MAX_OFFSET, MAX_COLUMNS, MAX_INDENTS, MAX_TABLES = 400, 1000, 32, 8
_CELLS = ("td", "th", "caption")


class Node:
    """An element: its name, attributes, and children (nodes and texts)."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


class _Builder:
    def __init__(self):
        self.root = Node("#root")
        self.open = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements, by name

    def _last(self, names: set[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, names: set[str], within: set[str]) -> bool:
        """End the innermost open element of these names that lies within bounds."""
        at = self._last(names)
        if not at or at < self._last(within - names):
            return False
        for node in self.open[at:]:
            self.places[node.name].pop()
        del self.open[at:]
        return True

    def push(self, name: str, attrs: dict[str, str] | None = None) -> Node:
        node = Node(name, attrs)
        self.open[-1].children.append(node)
        if name not in VOID:
            self.places[name].append(len(self.open))
            self.open.append(node)
        return node

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name not in IN_HEAD and name not in ("html", "body") and any(n.name == "head" for n in self.open[:4]):
            self.close({"head"}, set())
        if name in ("html", "body") and any(n.name == name for n in self.open[:4]):
            return
        if self.open[-1].name == "colgroup" and name not in IN_COLUMN_GROUP:
            self.close({"colgroup"}, set())
        if name in ENDS_CAPTION:
            self.close({"caption"}, {"table"})
        if name in ENDS_PARAGRAPH:
            self.close({"p"}, SCOPE | {"button", "object"})
        if name in ENDS:
            names, within = ENDS[name]
            if name == "tr":
                self.close({"td", "th"}, {"tr", "table"})
            while self.close(names, within):
                pass
        if name in ("td", "th") and self.open[-1].name in ("table", "tbody", "thead", "tfoot"):
            self.push("tr")
        self.push(name, attrs)

    def end(self, name: str) -> None:
        if name == "p" and not self.places.get("p"):
            self.push("p")
        if name == "br":
            self.push("br")
        table_part = name in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption")
        within = ({"table"} if name != "table" else set()) if table_part else SCOPE
        self.close({name}, within)

    def text(self, data: str) -> None:
        if len(self.open) > 1 and self.open[-1].name in ("head", "colgroup") and data.strip(" \t\n\r\f"):
            self.close({self.open[-1].name}, set())
        self.open[-1].children.append(data)


def tree(page: str) -> Node:
    """The page's tree."""
    builder, at = _Builder(), 0
    while at < len(page):
        found = _PIECE.match(page, at)
        if not found:  # a tag that never ends
            break
        at = found.end()
        if found["text"] is not None:
            builder.text(html.unescape(found["text"]))
        elif found["name"]:
            name = found["name"].lower()
            if found["end"]:
                builder.end(name)
                continue
            attrs = _attributes(found["attrs"]) if found["attrs"].strip() else {}
            builder.start(name, attrs)
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                inside = page[at : stop.start() if stop else len(page)]
                builder.open[-1].children.append(html.unescape(inside) if name in ("textarea", "title") else inside)
                builder.close({name}, set())
                at = stop.end() if stop else len(page)
            elif found["attrs"].endswith("/") and name in ("svg", "math", "path"):
                builder.close({name}, set())
    return builder.root


class _Page:
    """Lines of a page or a cell as they grow."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False  # whether the line so far ends in a blank that may go
        self.gap = False  # whether a blank line comes before the next text
        self.marker = ""
        self.indents: list[str] = []

    def add(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self.now.append(first)
            for line in rest:
                self.flush(keep=True)
                self.now.append(line)
            return
        text = _BLANKS.sub(" ", text)
        if text.startswith(" ") and (self.blank or not self.now):
            text = text[1:]
        if text:
            self.now.append(text)
            self.blank = text.endswith(" ")

    def flush(self, keep: bool = False) -> None:
        """End the line; an empty one is only kept where asked for."""
        line = "".join(self.now).rstrip(" ")
        self.now, self.blank = [], False
        if not line.strip(" \t") and not keep:
            return
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        indent = "".join(self.indents[:MAX_INDENTS])
        if self.marker:
            if len(self.indents) <= MAX_INDENTS:
                indent = indent[: -len(self.marker)]
            indent, self.marker = indent + self.marker, ""
        self.lines.append((indent + line).rstrip(" "))

    def text(self) -> str:
        self.flush()
        lines = list(self.lines)
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return "\n".join(lines)


class _Table:
    """Rows of cells as they grow; each cell is (text, columns, rows)."""

    def __init__(self):
        self.rows: list[list[tuple[str, int, int]]] = []
        self.caption = ""

    def lines(self) -> list[str]:
        grid: list[dict[int, list[str]]] = []
        taken: dict[int, int] = {}  # column -> rows it is still covered
        single: dict[int, int] = {}
        for row in self.rows:
            cells, at = {}, 0
            covered, taken = taken, {c: n - 1 for c, n in taken.items() if n > 1}
            for text, columns, rows in row:
                while at in covered:
                    at += 1
                cells[at] = text.split("\n")
                if columns == 1:
                    single[at] = max(single.get(at, 0), *map(len, cells[at]))
                if rows > 1:
                    taken.update({c: rows - 1 for c in range(at, min(at + columns, MAX_COLUMNS))})
                at += columns
            grid.append(cells)
        return [*(self.caption.split("\n") if self.caption else []), *_laid(grid, _starts(grid, single))]


def _starts(grid: list[dict[int, list[str]]], single: dict[int, int]) -> dict[int, int]:
    """Where each column in use begins: after the widths of those before it that have a width."""
    starts, offset = {}, 0
    for at in sorted({c for cells in grid for c in cells} | set(single)):
        starts[at] = min(offset, MAX_OFFSET)
        if at in single:
            offset += single[at] + 2
    return starts


def _laid(grid: list[dict[int, list[str]]], starts: dict[int, int]) -> Iterator[str]:
    for cells in grid:
        if not any(any(x) for x in cells.values()):
            continue
        # the cells that have a text in a line, in order of their columns
        by_line: list[list[tuple[int, str]]] = [[] for _ in range(max(map(len, cells.values())))]
        for at in sorted(cells):
            for k, part in enumerate(cells[at]):
                if part:
                    by_line[k].append((at, part))
        for parts in by_line:
            size, line = 0, []
            for at, part in parts:
                line.append(" " * (starts[at] - size) + part + "  ")
                size = max(size, starts[at]) + len(part) + 2
            yield "".join(line).rstrip(" ")


def _number(text: str | None, default: int) -> int:
    found = re.match(r"\s*(-?\d{1,9})", text or "")
    return int(found[1]) if found else default


def _hidden(node: Node) -> bool:
    attrs = node.attrs
    if node.name in UNSEEN:
        return True
    if not attrs:
        return False
    if "hidden" in attrs and attrs["hidden"].lower() != "until-found":
        return True
    if node.name == "input" and attrs.get("type", "text").lower() not in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
        return True
    if node.name == "dialog" and "open" not in attrs:
        return True
    return "style" in attrs and bool(_HIDES.search(attrs["style"]))


def render(root: Node) -> str:
    """The visible text of a tree."""
    pages, tables, numbers = [_Page()], [], []
    # what is still to do: (node or text, whether the node is left, visible, preformatted)
    todo: list[tuple] = [(root, False, True, False)]
    while todo:
        node, leaving, seen, kept = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if seen:
                page.add(node, kept)
            continue
        name = node.name
        if leaving:
            if name in _CELLS and tables and tables[-1] is None:
                page.flush()
            elif name in _CELLS and tables:
                pages.pop()
                if name == "caption":
                    tables[-1].caption = page.text()
                else:
                    spans = [min(MAX_SPAN, max(1, _number(node.attrs.get(s), 1))) for s in ("colspan", "rowspan")]
                    tables[-1].rows[-1].append((page.text(), *spans))
            elif name == "table":
                page.flush()
                table = tables.pop()
                for line in table.lines() if table else []:
                    page.now.append(line)
                    page.flush()
                page.gap = True
            elif name in BLOCKS:
                page.flush(keep=kept and bool(page.now))
                if name == "li":
                    page.indents.pop()
                    page.marker = ""
                elif name in ("dd", "blockquote"):
                    page.indents.pop()
                elif name in LISTS:
                    numbers.pop()
                if name in APART and not (name in LISTS and numbers):
                    page.gap = True
            continue
        if name == "br":
            page.flush(keep=True)
            continue
        if _hidden(node) and name != "#root":
            continue
        if node.attrs and (shown := _VISIBILITY.search(node.attrs.get("style", ""))):
            seen = shown[1].lower() == "visible"
        if name == "input":
            if seen:
                page.add(node.attrs.get("value", ""), False)
            continue
        if name == "dialog" and "open" not in node.attrs:
            continue
        children = node.children
        if name == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
        if name == "table":
            page.flush()
            page.gap = True
            # a table in many others is laid out as lines: its text goes where the cell's goes
            tables.append(_Table() if len(tables) < MAX_TABLES else None)
        elif (name == "tr" or name in _CELLS) and tables and tables[-1] is None:
            page.flush()
        elif name == "tr" and tables:
            tables[-1].rows.append([])
        elif name in _CELLS and tables:
            if name != "caption" and not tables[-1].rows:
                tables[-1].rows.append([])
            pages.append(_Page())
        elif name in BLOCKS:
            page.flush()
            if name in APART and not (name in LISTS and numbers):
                page.gap = True
            if name in LISTS:
                numbers.append(_number(node.attrs.get("start"), 1) if name == "ol" else None)
            elif name == "li":
                mark = "- "
                if numbers and numbers[-1] is not None:
                    number = _number(node.attrs.get("value"), numbers[-1])
                    mark, numbers[-1] = f"{number}. ", number + 1
                page.marker = mark
                page.indents.append(" " * len(mark))
            elif name in ("dd", "blockquote"):
                page.indents.append("    " if name == "dd" else "  ")
        kept = kept or name in ("pre", "textarea", "xmp")
        todo.append((node, True, seen, kept))
        todo.extend((c, False, seen, kept) for c in reversed(children))
    return pages[0].text()


def visible_text(page: str | None) -> str | None:
    """The visible text of one page."""
    return None if page is None else render(tree(page))


@F.pandas_udf(T.StringType())
def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A column function: page -> visible text."""
    for batch in pages:
        yield pd.Series([visible_text(p) for p in batch], dtype=object)
