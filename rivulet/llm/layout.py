"""Visible text of web pages, laid out as a browser would place it.

A tokenizer and a tree builder read any string as HTML: tags that HTML lets an
author leave out are implied, stray end tags are ignored, a quote that is never
closed ends with its tag, and nesting deeper than ``DEEPEST`` goes on at that
depth. Visibility follows the page's own style sheets and inline styles as they
hold on a screen (see ``styles``), the ``hidden`` attribute and closed dialogs
unless a style shows them, closed details, and elements that are never shown
(head, script, noscript, ...). Of an SVG drawing only its ``text`` and
``foreignObject`` show; formulas in MathML show without their annotations.

All other text is kept: paragraphs and headings stand between empty lines,
other blocks on lines of their own, list items behind bullets or numbers and
indented by depth, and table cells in aligned columns. After a cell that is too
long for its column (columns are at most ``WIDEST`` wide) the row goes on in
the next line, so that the next cell stands in its column all the same.
Buttons and fields show their values. White space is collapsed except in
preformatted text.

Defined cases: null and empty pages have an empty text; a null page_id is
carried along; repeated rows are rendered each; pages are rendered whole. An
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import html
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, steps
from .styles import Sheets

DEEPEST, WIDEST, GAP = 256, 60, "  "


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW, ESCAPABLE = _set("script style xmp iframe noembed noframes"), _set("textarea title")
UNSEEN = _set("head script style template noscript iframe noembed noframes datalist object audio video canvas title annotation annotation-xml")
#: Inside a drawing only these show.
DRAWN = _set("text foreignobject")
VALUED = _set("submit button reset text search url tel email number date time month week datetime-local")
SPACED = _set("p h1 h2 h3 h4 h5 h6 blockquote pre dl figure ul ol menu dir table xmp")
BLOCK = SPACED | _set("html body address article aside center details dialog div dd dt fieldset figcaption footer form header hgroup hr legend li main nav optgroup option search section summary tr td th caption thead tbody tfoot")
ENDS_P = BLOCK - _set("html body dd dt li option optgroup tr td th caption thead tbody tfoot legend") | _set("dd dt li")
#: Start tag -> (open elements that it ends, elements beyond which it does not look).
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (_set("li"), _set("ul ol menu dir table td th")),
    "dt": (_set("dt dd"), _set("dl table td th")),
    "dd": (_set("dt dd"), _set("dl table td th")),
    "tr": (_set("tr td th caption colgroup"), _set("table")),
    "td": (_set("td th caption"), _set("tr table")),
    "th": (_set("td th caption"), _set("tr table")),
    "thead": (_set("thead tbody tfoot tr td th caption colgroup"), _set("table")),
    "tbody": (_set("thead tbody tfoot tr td th caption colgroup"), _set("table")),
    "tfoot": (_set("thead tbody tfoot tr td th caption colgroup"), _set("table")),
    "option": (_set("option"), _set("select optgroup datalist")),
    "optgroup": (_set("option optgroup"), _set("select")),
    "rt": (_set("rt rp"), _set("ruby")),
    "rp": (_set("rt rp"), _set("ruby")),
    "body": (_set("head"), _set("")),
    **{h: (_set("h1 h2 h3 h4 h5 h6"), _set("div section article td th li body table")) for h in ("h1", "h2", "h3", "h4", "h5", "h6")},
}
_IN_HEAD = _set("base link meta title style script noscript template head html")
_FENCE = _set("table td th caption")  # an end tag does not reach out of these
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|([!?/]))")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)""")
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "before", "last")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.before = parent.last if parent else None  # the element before it
        self.last = None  # its last element
        if parent:
            parent.children.append(self)
            parent.last = self


class Builder:
    """Tree of a page, and its style sheets."""

    def __init__(self, page: str):
        self.root = Node("html", {})
        self.open, self.sheets = [self.root], Sheets()
        self.read(page)

    def read(self, page: str) -> None:
        at, n, lower = 0, len(page), None
        while at < n:
            m = _TAG.search(page, at)
            if not m:
                self.text(page[at:])
                return
            if m.start() > at:
                self.text(page[at : m.start()])
            close, name, comment, other = m.groups()
            if comment:
                end = page.find("-->", m.end())
                at = n if end < 0 else end + 3
                continue
            if other:
                end = page.find(">", m.end())
                at = n if end < 0 else end + 1
                continue
            name, (attrs, at) = name.lower(), self.attributes(page, m.end())
            if close:
                self.end(name)
                continue
            self.start(name, attrs)
            if page[at - 2 : at] == "/>" and self.open[-1].tag == name and any(x.tag in ("svg", "math") for x in self.open):
                self.open.pop()  # in drawings and formulas a slash ends an element
                continue
            if name in RAW or name in ESCAPABLE:
                lower = page.lower() if lower is None else lower
                if len(lower) != n:  # a few characters change their length in lower case
                    lower = re.sub("[A-Z]+", lambda x: x[0].lower(), page)
                end = lower.find(f"</{name}", at)
                end = n if end < 0 else end
                if body := page[at:end]:
                    self.open[-1].children.append(html.unescape(body) if name in ESCAPABLE else body)
                if name == "style" and attrs.get("type", "").lower() in ("", "text/css"):
                    self.sheets.add(body, attrs.get("media", ""))
                at = end
                if end == n:
                    return

    @staticmethod
    def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
        attrs: dict[str, str] = {}
        while m := _ATTRIBUTE.match(page, at):
            at = m.end()
            if m[1]:
                return attrs, at
            value = next((v for v in m.groups()[2:] if v is not None), "")
            attrs.setdefault(m[2].lower(), html.unescape(value) if "&" in value else value)
        return attrs, len(page)

    def text(self, raw: str) -> None:
        if not raw.strip(" \t\n\r\f"):
            self.open[-1].children.append(raw)
            return
        if self.open[-1].tag == "head":
            self.open.pop()
        self.open[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    def close(self, tags: frozenset[str], fence: frozenset[str]) -> None:
        """End the innermost open element of ``tags`` that is not beyond ``fence``, and all others of them inside it."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                while k > 1 and self.open[k - 1].tag in tags:
                    k -= 1
                del self.open[k:]
                return
            if tag in fence:
                return

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html" or tag == "body" and any(x.tag == "body" for x in self.open):
            own = next(x for x in self.open if x.tag == tag)
            own.attrs = attrs | own.attrs  # what is said first holds
            return
        if self.open[-1].tag == "head" and tag not in _IN_HEAD:
            self.open.pop()
        if tag in ENDS_P:
            self.close(_set("p"), _FENCE | _set("button"))
        if tag in ENDS:
            self.close(*ENDS[tag])
        if len(self.open) >= DEEPEST:
            self.open.pop()
        node = Node(tag, attrs, self.open[-1])
        if tag not in VOID:
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
            return
        if tag in ("html", "body"):
            return
        fence = _set("table") if tag in _FENCE or tag in ("tr", "thead", "tbody", "tfoot") else _FENCE
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in fence:
                return


class Flow:
    """Lines of text that grow by words, breaks and blocks of ready lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.need, self.space = 0, False

    def room(self) -> None:
        """Before the first text of a line: the empty line that is due."""
        if self.need > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.need = 0

    def words(self, text: str) -> None:
        text = _SPACES.sub(" ", text)
        if text == " ":
            self.space = bool(self.line)
            return
        if not text:
            return
        if not self.line:
            self.room()
        elif self.space or text[0] == " ":
            self.line.append(" ")
        self.space = text[-1] == " "
        self.line.append(text.strip(" "))

    def ready(self, text: str) -> None:
        """Preformatted text."""
        for k, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self.turn()
            if part:
                if not self.line:
                    self.room()
                self.line.append(part)
        self.space = False

    def turn(self) -> None:
        """A line ends here, even if it is empty."""
        if self.line or self.lines:
            self.room()
            self.lines.append("".join(self.line))
        self.line, self.space = [], False

    def rest(self, lines: int) -> None:
        """What follows is on a new line, after an empty one if ``lines`` is 2."""
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        self.need, self.space = max(self.need, lines), False

    def block(self, lines: list[str]) -> None:
        self.rest(1)
        if lines:
            self.room()
            self.lines.extend(lines)
            self.need = 1

    def done(self) -> list[str]:
        self.rest(0)
        lo, hi = 0, len(self.lines)
        while lo < hi and not self.lines[lo].strip():
            lo += 1
        while hi > lo and not self.lines[hi - 1].strip():
            hi -= 1
        return [x.rstrip() for x in self.lines[lo:hi]]


class Renderer:
    def __init__(self, page: str):
        built = Builder(page)
        self.sheets, self.root = built.sheets, built.root

    def text(self) -> str:
        shown = self.seen(self.root, True)
        return "" if shown is None else "\n".join(self.lines(self.root, False, shown, 0))

    def lines(self, node: Node, pre: bool, seen: bool, depth: int) -> list[str]:
        flow = Flow()
        self.inside(node, flow, pre, seen, depth)
        return flow.done()

    def seen(self, node: Node, seen: bool) -> bool | None:
        """None: neither the element nor anything in it; else whether its own text shows."""
        tag, a = node.tag, node.attrs
        if tag in UNSEEN:
            return None
        how = self.sheets.of(node) if self.sheets.rules or "style" in a else {}
        kept_back = "hidden" in a and a["hidden"].lower() != "until-found" or tag == "dialog" and "open" not in a
        if how.get("display", "none" if kept_back else "") == "none":
            return None
        visible = how.get("visibility", "inherit")
        return seen if visible in ("inherit", "unset") else visible not in ("hidden", "collapse")

    def inside(self, node: Node, flow: Flow, pre: bool, seen: bool, depth: int) -> None:
        shut = node.tag == "details" and "open" not in node.attrs
        for child in node.children:
            if isinstance(child, str):
                if seen and not shut:
                    (flow.ready if pre else flow.words)(child)
            elif not shut or child.tag == "summary":
                self.element(child, flow, pre, seen, depth)

    def element(self, node: Node, flow: Flow, pre: bool, seen: bool, depth: int) -> None:
        tag = node.tag
        if tag == "br":
            flow.turn()
            return
        shown = self.seen(node, seen)
        if shown is None:
            return
        if tag == "input":
            kind = node.attrs.get("type", "text").lower()
            if shown and kind in VALUED:
                for part in (" ", node.attrs.get("value") or {"submit": "Submit", "reset": "Reset"}.get(kind, ""), " "):
                    flow.words(part)
            return
        if tag in VOID and tag != "hr":
            return
        if tag == "svg":
            self.drawing(node, flow, pre, shown, depth)
            return
        if tag == "table":
            flow.rest(2)
            flow.block(self.table(node, pre, shown, depth))
            flow.rest(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            apart = 1 if depth else 2
            flow.rest(apart)
            self.items(node, flow, pre, shown, depth)
            flow.rest(apart)
        elif tag in ("li", "blockquote", "dd"):
            flow.rest(2 if tag == "blockquote" else 1)
            self.indented(node, flow, "- " if tag == "li" else GAP, pre, shown, depth + (tag == "li"))
            flow.rest(2 if tag == "blockquote" else 1)
        elif tag in BLOCK:
            apart = 2 if tag in SPACED else 1
            flow.rest(apart)
            self.inside(node, flow, pre or tag in ("pre", "xmp"), shown, depth)
            flow.rest(apart)
        else:
            self.inside(node, flow, pre or tag in ("textarea", "listing"), shown, depth)

    def drawing(self, node: Node, flow: Flow, pre: bool, seen: bool, depth: int) -> None:
        """Texts of a drawing, each a word of its own; what is only defined is not drawn."""
        for child in node.children:
            if isinstance(child, str) or child.tag in ("defs", "symbol", "clippath", "mask", "marker", "pattern", "metadata", "desc"):
                continue
            shown = self.seen(child, seen)
            if shown is None:
                continue
            if child.tag in DRAWN:
                flow.words(" ")
                self.inside(child, flow, pre, shown, depth)
                flow.words(" ")
            else:
                self.drawing(child, flow, pre, shown, depth)

    def indented(self, node: Node, flow: Flow, mark: str, pre: bool, seen: bool, depth: int) -> None:
        body, blank = self.lines(node, pre, seen, depth), " " * len(mark)
        flow.block([(blank if k else mark) + x if x or not k else "" for k, x in enumerate(body)])

    def items(self, node: Node, flow: Flow, pre: bool, seen: bool, depth: int) -> None:
        number = _number(node.attrs.get("start"), 1)
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                shown = self.seen(child, seen)
                if shown is None:
                    continue
                number = _number(child.attrs.get("value"), number)
                self.indented(child, flow, f"{number}. " if node.tag == "ol" else "- ", pre, shown, depth + 1)
                number += 1
            elif isinstance(child, Node):
                self.element(child, flow, pre, seen, depth + 1)
            elif seen:
                flow.words(child)

    def table(self, node: Node, pre: bool, seen: bool, depth: int) -> list[str]:
        """Captions and stray content first, then the rows, with cells in columns."""
        before, rows = Flow(), []

        def gather(parent: Node, seen: bool, row: list | None) -> None:
            for child in parent.children:
                if isinstance(child, str):
                    if seen:
                        before.words(child)
                    continue
                shown = self.seen(child, seen)
                if shown is None:
                    continue
                if child.tag in ("thead", "tbody", "tfoot"):
                    gather(child, shown, None)
                elif child.tag == "tr":
                    rows.append(cells := [])
                    gather(child, shown, cells)
                elif child.tag in ("td", "th"):
                    if row is None:
                        rows.append(row := [])
                    span = [max(1, min(1000, _number(child.attrs.get(k), 1))) for k in ("colspan", "rowspan")]
                    row.append((self.lines(child, pre, shown, 0), *span))
                else:
                    self.element(child, before, pre, seen, depth)
                    before.rest(1)

        gather(node, seen, None)
        placed, busy, width = [], {}, {}  # busy: rows that a cell above still takes in a column
        for cells in rows:
            at, line, begun = 0, [], {}
            for body, columns, deep in cells:
                while busy.get(at):
                    at += 1
                line.append((at, body))
                if columns == 1:
                    width[at] = max(width.get(at, 0), min(WIDEST, max(map(len, body), default=0)))
                if deep > 1:
                    begun |= dict.fromkeys(range(at, at + columns), deep - 1)
                at += columns
            busy = {k: n - 1 for k, n in busy.items() if n > 1} | begun
            placed.append(line)
        left, total = {}, 0
        for k in sorted(width):
            left[k] = total
            total += width[k] + len(GAP)
        out = []
        for line in placed:
            for k in range(max((len(body) for _, body in line), default=0)):
                text = ""
                for at, body in line:
                    if k < len(body) and body[k]:
                        goal = left.get(at, 0)
                        if text and len(text) + len(GAP) > goal:
                            out.append(text)
                            text = ""
                        text = text.ljust(goal) + body[k]
                out.append(text)
        head = before.done()
        return head + out


def _number(text: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(m[1]) if m else default


def render(page: str | None) -> str:
    """The visible text of one page."""
    return Renderer(page).text() if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id and text of every page."""

    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))
        for b in steps(batches, "html"):
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([render(x) for x in b.column("html").to_pylist()], pa.string())], ["page_id", "text"])

    return only(pages, "page_id", "html").mapInArrow(run, "page_id long, text string")
