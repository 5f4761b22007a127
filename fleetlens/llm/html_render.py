"""HTML extraction by layout: a tree with implied tags, rendered as a reader would see it.

The tree builder follows the rules that matter for text: start and end tags
that may be left out, raw text elements, text in a table that moves before it.
Rendering emits all visible text.  Blocks stand on lines of their own, with a
blank line around paragraphs, headings, lists and tables; lists have markers
and indentation; table cells are padded to columns; preformatted text keeps
its white space.

Hidden are the head, scripts, styles and other elements that show no text,
elements with ``hidden`` or ``display:none``, closed dialogs and the content of
closed details; ``visibility`` is inherited and can be turned on again below.
Both properties are read from style attributes and from the page's style
elements, there from rules by tag, class and id; rules with other selectors and
at-rules (media queries) have no effect.  Formulas show their text, drawings
what their text elements hold.

Null and empty pages give an empty text.  As in browsers, elements nested deeper
than ``DEPTH`` stand beside each other, so no depth of nesting fails.  Cells of
more than ``PAD`` columns are wrapped, so that later ones still align.  Repeated
rows give equal rows; other columns than page_id and html are not read.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 512  # elements nested deeper stand beside each other, as in browsers
PAD = 60  # the text of a cell is wrapped to so many columns; longer words stand out
SPANS = 1000  # columns that one cell may span
FRAMES = 12 * DEPTH  # nested calls that the deepest page takes

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title annotation annotation-xml".split())
# Of a drawing only these show text.
DRAWN_TEXT = frozenset(("text", "foreignobject"))
UNDRAWN = frozenset("defs symbol desc metadata clippath mask pattern marker lineargradient radialgradient filter".split())
BLANK = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre xmp figure hr fieldset".split())
LINE = frozenset(
    "address article aside body center dd details dialog div dt figcaption footer form header html legend li main nav optgroup option "
    "search section summary tr caption".split()
)
CLOSES_P = (BLANK | LINE) - frozenset("body html li dd dt tr caption legend optgroup option summary".split()) | {"summary"}
ROWS = frozenset("thead tbody tfoot".split())
CELLS = frozenset(("td", "th"))
# A start tag ends these open elements, up to the scope's border.
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "table"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))), "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "table"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select", "table"))),
    "td": (CELLS, frozenset(("table", "tr"))), "th": (CELLS, frozenset(("table", "tr"))),
    "tr": (CELLS | {"tr", "caption"}, frozenset(("table",) + tuple(ROWS))),
    **{t: (CELLS | ROWS | {"tr", "caption", "colgroup"}, frozenset(("table",))) for t in ROWS | {"caption", "colgroup"}},
}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)\s*(=?)\s*")
UNQUOTED = re.compile(r"[^\s>]*")
WHITE = re.compile(r"[ \t\n\r\f]+")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.IGNORECASE)
SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
PART_OF_SELECTOR = re.compile(r"[.#][\w-]+")
BRACE = re.compile(r"[{}]")


class Node:
    """An element; ``visible`` is None where it is as its parent is."""

    __slots__ = ("tag", "attrs", "children", "hidden", "visible")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []
        self.hidden, self.visible = False, None


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text), ("start", tag, attributes) and ("end", tag); one pass, in time linear in the page."""
    at, n = 0, len(html)
    while at < n:
        open_at = html.find("<", at)
        if open_at < 0:
            yield "text", html[at:], {}
            return
        if open_at > at:
            yield "text", html[at:open_at], {}
        after = html[open_at + 1 : open_at + 2]
        if after in ("!", "?"):
            if html.startswith("<!--", open_at):
                end = html.find("-->", open_at + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", open_at)
                at = n if end < 0 else end + 1
            continue
        closing = after == "/"
        name = NAME.match(html, open_at + 1 + closing)
        if name is None:
            if closing:  # a broken end tag is a comment
                end = html.find(">", open_at)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", {}
                at = open_at + 1
            continue
        tag, at, attrs = name.group().lower(), name.end(), {}
        while at < n and html[at] != ">":
            found = ATTRIBUTE.match(html, at)
            if found is None:
                at += 1
                continue
            at, value = found.end(), ""
            if found.group(2):
                quote = html[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = html.find(quote, at + 1)
                    if end < 0:
                        return  # the page ends inside a tag
                    value, at = html[at + 1 : end], end + 1
                else:
                    bare = UNQUOTED.match(html, at)
                    value, at = bare.group(), bare.end()
            attrs.setdefault(found.group(1).lower(), unescape(value))
        if html[at - 1 : at] == "/":
            attrs["/"] = ""  # counts in drawings and formulas only
        at += 1
        yield ("end" if closing else "start"), tag, attrs
        if not closing and tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            stop = end.start() if end else n
            if stop > at:
                yield ("text" if tag in ("title", "textarea") else "plain" if tag == "xmp" else "raw"), html[at:stop], {}
            at = stop


def tree(html: str) -> Node:
    """The page's elements, tags that may be left out supplied."""
    root = Node("body", {})
    stack = [root]
    opened: Counter = Counter()  # never less than the elements of that name on the stack

    def close(tags: frozenset, borders: frozenset) -> None:
        if not any(opened[tag] for tag in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in borders:
                return
            if stack[i].tag in tags:
                opened.subtract(node.tag for node in stack[i:])
                del stack[i:]
                # Go on: a row start ends the cell and then the row.
                close(tags, borders)
                return

    def close_paragraph() -> None:
        for i in range(len(stack) - 1 if opened["p"] else 0, 0, -1):
            if stack[i].tag == "p":
                opened.subtract(node.tag for node in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in ("table", "td", "th", "button", "caption", "object", "template"):
                return

    def parent_of(tag: str) -> Node:
        """Where a child goes: before the table if it has no place inside it."""
        top = stack[-1]
        inside = {"table": ROWS | {"tr", "caption", "colgroup", "col", "td", "th"}, "tr": CELLS}
        allowed = inside.get(top.tag) or (frozenset(("tr", "td", "th")) if top.tag in ROWS else None)
        if allowed is None or tag in allowed or tag in HIDDEN or tag == "form":
            return top
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "table":
                before = stack[i - 1]
                moved = before.children[-2] if len(before.children) > 1 and isinstance(before.children[-2], Node) and before.children[-2].tag == "#moved" else None
                if moved is None:
                    moved = Node("#moved", {})
                    before.children.insert(len(before.children) - 1, moved)
                return moved
        return top

    for kind, value, attrs in tokens(html):
        if kind == "text":
            if value.strip(" \t\n\r\f") or stack[-1].tag not in ("table", "tr", *ROWS):
                parent_of("#text").children.append(unescape(value))
        elif kind == "raw":
            if stack[-1].tag == "style":
                stack[-1].children.append(value)
        elif kind == "plain":  # shown as it stands, without character references
            stack[-1].children.append(value)
        elif kind == "start":
            if value in ("html", "body", "head"):
                if value == "head":
                    opened["head"] += 1
                    stack.append(Node("head", attrs))
                    stack[-2].children.append(stack[-1])
                else:
                    stack[:] = [s for s in stack if s.tag != "head"]
                    root.attrs.update({k: v for k, v in attrs.items() if k not in root.attrs})
                continue
            if stack[-1].tag == "head" and value not in ("base", "link", "meta", "title", "style", "script", "noscript", "template"):
                stack.pop()  # the body starts
            if value in CLOSES_P:
                close_paragraph()
            if value in ENDS:
                close(*ENDS[value])
            if value in CELLS and stack[-1].tag in ROWS | {"table"}:
                row = Node("tr", {})
                stack[-1].children.append(row)
                opened["tr"] += 1
                stack.append(row)
            node = Node(value, attrs)
            (parent_of(value) if len(stack) < DEPTH else stack[DEPTH - 1]).children.append(node)
            if value == "form" and stack[-1].tag in ROWS | {"table", "tr"}:
                continue  # between cells a form holds nothing
            if value not in VOID and not ("/" in attrs and (opened["svg"] or opened["math"])):
                opened[value] += 1
                stack.append(node)
        elif kind == "end":
            if value == "br":
                stack[-1].children.append(Node("br", {}))
            elif value not in ("html", "body"):
                if not opened[value]:
                    continue
                border = frozenset(("table",)) if value not in ROWS | CELLS | {"table", "tr", "caption"} else frozenset()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == value:
                        opened.subtract(node.tag for node in stack[i:])
                        del stack[i:]
                        break
                    if stack[i].tag in border:
                        break
    return root


def declared(text: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a list of declarations, and whether they are marked as important."""
    found: dict[str, tuple[bool, str]] = {}
    for name, value, important in DECLARED.findall(text):
        if not important and found.get(name.lower(), (False, ""))[0]:
            continue
        found[name.lower()] = bool(important), value.lower()
    return found


def sheet_rules(sheet: str) -> Iterator[tuple[str, frozenset[str], str, dict[str, tuple[bool, str]]]]:
    """Tag, classes, id and declarations of the rules whose selectors have no more than these; at-rules are left out."""
    sheet = COMMENT.sub(" ", sheet)
    at = 0
    while (start := sheet.find("{", at)) >= 0:
        selectors = sheet[at:start].rpartition(";")[2].strip()
        if selectors.startswith("@"):
            depth, at = 1, start + 1
            for brace in BRACE.finditer(sheet, at):
                depth += 1 if brace.group() == "{" else -1
                at = brace.end()
                if not depth:
                    break
            else:
                return
            continue
        end = sheet.find("}", start)
        end = len(sheet) if end < 0 else end
        at = end + 1
        if found := declared(sheet[start + 1 : end]):
            for selector in selectors.split(","):
                if selector.strip() and (simple := SIMPLE.fullmatch(selector.strip())):
                    names = PART_OF_SELECTOR.findall(simple.group(2))
                    ids = [name[1:] for name in names if name[0] == "#"]
                    if len(set(ids)) < 2:
                        yield (simple.group(1) or "*").lower(), frozenset(name[1:] for name in names if name[0] == "."), "".join(ids[:1]), found


def apply_styles(root: Node) -> None:
    """Tell of every element whether it is left out, and whether its text shows.

    Style attributes count, and rules of the page's style elements by tag, class
    and id; of several the important, the more specific, the later one.
    """
    nodes, sheets = [root], []
    for node in nodes:
        if node.tag == "style":
            sheets += [child for child in node.children if isinstance(child, str)]
        nodes += [child for child in node.children if isinstance(child, Node)]
    rules: dict[str, list[tuple]] = defaultdict(list)
    for order, (tag, classes, name, found) in enumerate(rule for sheet in sheets for rule in sheet_rules(sheet)):
        key = "#" + name if name else "." + min(classes) if classes else tag
        rules[key].append(((len(name) > 0, len(classes), tag != "*", order), tag, classes, name, found))
    for node in nodes:
        style = {name: (important, (2, 0, 0, 0), value) for name, (important, value) in declared(node.attrs.get("style", "")).items()}
        if rules:
            classes = frozenset(node.attrs.get("class", "").split())
            for key in ("*", node.tag, *("." + c for c in classes), "#" + node.attrs.get("id", "")):
                for weight, tag, wanted, name, found in rules.get(key, ()):
                    if tag in ("*", node.tag) and wanted <= classes and (not name or name == node.attrs.get("id")):
                        for what, (important, value) in found.items():
                            style[what] = max(style.get(what, (False, (-1,), "")), (important, weight, value))
        display = style.get("display", (False, (), ""))[2]
        left_out = "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs)
        node.hidden = node.tag in HIDDEN or (display == "none" if display else left_out)
        node.visible = {"visible": True, "initial": True, "hidden": False, "collapse": False}.get(style.get("visibility", (False, (), ""))[2])


def shows(node: Node, visible: bool) -> bool:
    return visible if node.visible is None else node.visible


def width(text: str) -> int:
    """Columns that a line takes; wide characters take two."""
    return len(text) if text.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of text with white space collapsed and gaps between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0

    def text(self, text: str) -> None:
        words = WHITE.split(text)
        if words[0] == "" and len(words) > 1:
            self.space = True
        kept = [w for w in words if w]
        if kept:
            self._settle()
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(" ".join(kept))
            self.space = len(words) > 1 and words[-1] == ""

    def _settle(self) -> None:
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0

    def end_line(self) -> None:
        if self.parts:
            self.lines.append("".join(self.parts))
        self.parts, self.space = [], False

    def line_break(self) -> None:
        if self.parts:
            self.end_line()
        else:
            self._settle()
            self.lines.append("")

    def block(self, gap: int) -> None:
        """From here on a new line, after ``gap`` - 1 blank ones."""
        self.end_line()
        self.gap = max(self.gap, gap)

    def put(self, lines: list[str], gap: int) -> None:
        self.block(gap)
        if lines:
            self._settle()
            self.lines += lines
            self.gap = gap

    def finish(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        start = next((i for i, line in enumerate(self.lines) if line.strip()), 0)
        return [line.rstrip() for line in self.lines[start:]]


def _whole(text: str | None, default: int, most: int) -> int:
    found = re.match(r"\s*(-?\d{1,9})", text or "")
    return min(most, int(found.group(1))) if found else default


def render(node: Node, flow: Flow, visible: bool = True, pre: bool = False, depth: int = 0) -> None:
    """Children of ``node`` into ``flow``."""
    for child in node.children:
        if isinstance(child, str):
            if not visible:
                continue
            if pre:
                first, *more = child.replace("\r\n", "\n").split("\n")
                for i, line in enumerate([first, *more]):
                    if i:
                        flow.line_break()
                    if line:
                        flow._settle()
                        flow.parts.append(line)
            else:
                flow.text(child)
            continue
        element(child, flow, visible, pre, depth)


def element(node: Node, flow: Flow, visible: bool, pre: bool, depth: int) -> None:
    tag, attrs = node.tag, node.attrs
    if node.hidden:
        return
    visible = shows(node, visible)
    if tag == "svg":
        drawing(node, flow, visible, depth)
    elif tag == "br":
        if visible:
            flow.line_break()
    elif tag == "hr":
        flow.block(2)
    elif tag == "input":
        if visible and attrs.get("type", "").lower() in ("button", "submit", "reset"):
            flow.text(attrs.get("value", ""))
    elif tag in ("ul", "ol", "menu"):
        flow.put(listed(node, visible, depth), 2 if depth == 0 else 1)
    elif tag == "table":
        flow.put(table(node, visible, depth), 2)
    elif tag in ("dd", "blockquote"):
        inner = Flow()
        render(node, inner, visible, pre, depth)
        flow.put([("  " + line).rstrip() for line in inner.finish()], 2 if tag == "blockquote" else 1)
    elif tag == "details" and "open" not in attrs:
        flow.block(1)
        for child in node.children:
            if isinstance(child, Node) and child.tag == "summary":
                element(child, flow, visible, pre, depth)
                break
        flow.block(1)
    elif tag in ("pre", "xmp"):
        flow.block(2)
        if tag == "pre" and node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
            node.children[0] = node.children[0][1:]
        render(node, flow, visible, True, depth)
        flow.block(2)
    elif tag == "li":  # outside any list
        flow.put(item("- ", node, visible, depth), 1)
    else:
        gap = 2 if tag in BLANK else 1 if tag in LINE or tag == "#moved" else 0
        if gap:
            flow.block(gap)
        render(node, flow, visible, pre, depth)
        if gap:
            flow.block(gap)


def drawing(node: Node, flow: Flow, visible: bool, depth: int) -> None:
    """The texts of a drawing, each on lines of its own."""
    for child in node.children:
        if isinstance(child, Node) and not child.hidden and child.tag not in UNDRAWN:
            if child.tag in DRAWN_TEXT:
                flow.block(1)
                render(child, flow, shows(child, visible), False, depth)
                flow.block(1)
            else:
                drawing(child, flow, shows(child, visible), depth)


def item(marker: str, node: Node, visible: bool, depth: int) -> list[str]:
    inner = Flow()
    render(node, inner, visible, False, depth + 1)
    lines = inner.finish()
    return [(marker if i == 0 else " " * len(marker)) + line if line else "" for i, line in enumerate(lines)]


def listed(node: Node, visible: bool, depth: int) -> list[str]:
    """Items with markers; what stands between items keeps its place."""
    out = Flow()
    number = _whole(node.attrs.get("start"), 1, 10**9)
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            if child.hidden:
                continue
            shown = shows(child, visible)
            number = _whole(child.attrs.get("value"), number, 10**9)
            out.put(item(f"{number}. " if node.tag == "ol" else "- ", child, shown, depth), 1)
            number += 1
        elif isinstance(child, Node):
            element(child, out, visible, False, depth + 1)
        elif visible:
            out.text(child)
    return out.finish()


def wrapped(lines: list[str], most: int) -> list[str]:
    """Lines of ``most`` columns or one longer word."""
    out = []
    for line in lines:
        if width(line) <= most:
            out.append(line)
            continue
        part, used = [], 0
        for word in line.split(" "):
            size = width(word)
            if part and used + 1 + size > most:
                out.append(" ".join(part))
                part, used = [], 0
            used += size + (1 if part else 0)
            part.append(word)
        out.append(" ".join(part))
    return out


def table(node: Node, visible: bool, depth: int) -> list[str]:
    """Caption, then rows with cells padded to columns; header, body and footer rows in this order."""
    caption, rows = Flow(), {"thead": [], "tbody": [], "tfoot": []}

    def collect(parent: Node, part: str, shown: bool) -> None:
        for child in parent.children:
            if not isinstance(child, Node):
                continue
            if child.hidden:
                continue
            seen = shows(child, shown)
            if child.tag == "tr":
                rows[part].append((child, seen))
            elif child.tag in ROWS:
                collect(child, child.tag, seen)
            elif child.tag == "caption":
                element(child, caption, shown, False, depth)

    collect(node, "tbody", visible)
    grid: list[list[tuple[int, int, list[str]]]] = []
    open_spans: dict[int, int] = {}
    for row, shown in [*rows["thead"], *rows["tbody"], *rows["tfoot"]]:
        cells, column = [], 0
        for cell in row.children:
            if not isinstance(cell, Node) or cell.tag not in CELLS:
                continue
            if cell.hidden:
                continue
            while open_spans.get(column, 0) > 0:
                column += 1
            inner = Flow()
            render(cell, inner, shows(cell, shown), False, 0)
            span = max(1, _whole(cell.attrs.get("colspan"), 1, SPANS))
            cells.append((column, span, inner.finish()))
            down = _whole(cell.attrs.get("rowspan"), 1, 65534)
            for c in range(column, column + span):
                open_spans[c] = max(1, down) if down else 1 << 20
            column += span
        open_spans = {c: left - 1 for c, left in open_spans.items() if left > 1}
        grid.append(cells)
    if max((column + span for cells in grid for column, span, _ in cells), default=0) > 1:
        grid = [[(column, span, wrapped(lines, PAD * span)) for column, span, lines in cells] for cells in grid]
    widths: dict[int, int] = {}
    for cells in grid:
        for column, span, lines in cells:
            size = max((width(line) for line in lines), default=0)
            if span == 1:
                widths[column] = max(widths.get(column, 0), min(size, PAD))
    for cells in grid:
        for column, span, lines in cells:
            size = max((width(line) for line in lines), default=0)
            have = sum(widths[c] + 2 for c in range(column, column + span) if widths.get(c)) - 2
            size = min(size, PAD * span)
            if 1 < span and have < size:
                last = column + span - 1
                widths[last] = size - have + widths[last] if widths.get(last) else size - have - 2 if have > 0 else size
    starts, total = {}, 0
    for column in range(max((c + s for cells in grid for c, s, _ in cells), default=0)):
        starts[column] = total
        total += widths[column] + 2 if widths.get(column) else 0
    out = caption.finish()
    for cells in grid:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, used = [], 0
            for column, _, lines in cells:
                if i < len(lines) and lines[i]:
                    at = max(starts[column], used + 2 if used else 0)
                    line.append(" " * (at - used) + lines[i])
                    used = at + width(lines[i])
            out.append("".join(line).rstrip())
    return out


def visible_text(html: str | None) -> str:
    """The text of a page as it is laid out; lines end with a newline between them."""
    if not html:
        return ""
    flow = Flow()
    body = Node("#page", {})
    body.children = [tree(html)]
    apply_styles(body)
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)
    render(body, flow)
    return "\n".join(flow.finish())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, and the number of its lines and words, of every page."""

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = [visible_text(html) for html in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column("page_id"), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                    pa.array([len(t.split()) for t in texts], pa.int64()),
                ], ["page_id", "text", "n_lines", "n_words"])

    chosen = pages.select(F.col("page_id").cast("bigint"), F.col("html").cast("string"))
    return chosen.mapInArrow(rendered, "page_id bigint, text string, n_lines bigint, n_words bigint")
