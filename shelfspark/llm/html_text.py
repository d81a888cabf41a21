"""Layout-aware text of HTML pages.

A tree builder over the standard tokenizer applies implied end tags, ignores
strays and closes what is left open; a renderer walks the tree and emits all
visible text. Blocks stand on lines of their own with a blank line around
paragraphs, headings and lists; items have bullets or numbers and are indented by
depth; tables become rows of cells padded to the width of their columns, with
colspan and rowspan; runs of white space fold to one space except in pre.

Visible is what a browser with scripts lays out: not the head, script, style,
template, noscript and the fallback of embedded media, not elements with the hidden
attribute or display:none, closed dialogs and the inside of closed details; text
under visibility:hidden is left out but for descendants that are visible again.
aria-hidden hides nothing from the eye. Of svg the text elements count, of select
the options that show, of inputs the value, of images the alternative text.

Bounds that keep output in proportion to the page: lines are indented by at most
INDENT columns; a cell wider than PAD columns does not widen its column; a table
whose grid would have more than GRID slots is not padded from there on. Spans are
bounded as the HTML standard bounds them. No text is dropped by any of them.

Null and empty pages give empty text. Pages of any length and depth are handled
without recursion, in time that grows with their length (times the depth of nested
tables). Repeated rows are rendered one by one; a column named like the result is
replaced. Empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard, and the spacing that browsers give by default.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"audio", "canvas", "datalist", "head", "iframe", "noembed", "noframes", "noscript", "object", "rp", "script", "style", "template", "title", "video", "annotation", "annotation-xml"}
HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SPACED = HEADINGS | {"blockquote", "dl", "figure", "hr", "ol", "p", "pre", "table", "ul"}
BLOCK = SPACED | {"address", "article", "aside", "body", "caption", "center", "dd", "details", "dialog", "div", "dt", "fieldset", "figcaption", "footer", "form", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "option", "search", "section", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSES_P = HEADINGS | {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
LISTS = {"ul", "ol", "menu"}
P_SCOPE = {"table", "td", "th", "button", "caption", "template", "object"}
CELL_SCOPE = {"td", "th", "caption", "table", "template"}
TABLE_TAGS = {"table", "caption", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
_PARTS = {"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}
#: A start tag closes these open elements, up to the nearest of the scope's.
IMPLIED = {
    "li": ({"li"}, LISTS | CELL_SCOPE),
    "dt": ({"dt", "dd"}, {"dl"} | CELL_SCOPE),
    "dd": ({"dt", "dd"}, {"dl"} | CELL_SCOPE),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": (_PARTS, {"table"}),
    "tbody": (_PARTS, {"table"}),
    "tfoot": (_PARTS, {"table"}),
}
COLSPAN, ROWSPAN = 1000, 65534
SHOWN_INPUTS = {"button", "date", "email", "number", "reset", "search", "submit", "tel", "text", "time", "url"}

INDENT = 64
PAD = 120
GRID = 1_000_000

_BLANK = re.compile(r"[ \t\n\r\f]+")
#: What the tokenizer is not given: comments, as the standard ends them, and elements whose raw text is never shown.
_SKIP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)", re.S | re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Builder(HTMLParser):
    """Tree of a page; children are nodes and strings."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of each tag

    def _nearest(self, tags: set[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _cut(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.at[node.tag].pop()
        del self.open[depth:]

    def _close(self, tags: set[str], scope: set[str]) -> bool:
        """Pops the outermost of tags above the nearest of scope, and all within; whether there was one."""
        floor = self._nearest(scope - tags)
        found = [d[i] for d in (self.at.get(t, ()) for t in tags) if (i := bisect_right(d, floor)) < len(d)]
        if found:
            self._cut(min(found))
        return bool(found)

    def _push(self, tag: str, attrs: dict[str, str | None]) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.at[tag].append(len(self.open))
            self.open.append(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "head", "body") and (self.at["body"] or self.at[tag]):
            return
        if self.open[-1].tag == "head" and tag not in HEAD:
            self._cut(len(self.open) - 1)
        if tag in CLOSES_P:
            self._close({"p"}, P_SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._cut(len(self.open) - 1)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", {})
        self._push(tag, dict(reversed(attrs)))  # the first of repeated attributes counts

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if (self.at["svg"] or self.at["math"]) and self.open[-1].tag == tag:  # only there a slash ends the element
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._push("br", {})
            return
        tags = HEADINGS if tag in HEADINGS else {tag}
        scope = {"table"} if tag in TABLE_TAGS - {"table"} else set() if tag == "table" else CELL_SCOPE
        depth = self._nearest(tags)
        if depth > self._nearest(scope - tags):
            self._cut(depth)
        elif tag == "p":
            self._push("p", {})
            self._cut(len(self.open) - 1)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip(" \t\n\r\f"):
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(data)


def parse(page: str) -> Node:
    b = Builder()
    b.feed(_SKIP.sub("", page))
    b.close()
    return b.root


def declared(style: str | None) -> dict[str, str]:
    """Properties of a style attribute; the last counts, but for those that are important."""
    out: dict[str, str] = {}
    strong: set[str] = set()
    for part in (style or "").lower().split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip(), value.strip()
        important = value.endswith("important") and "!" in value
        if name and (important or name not in strong):
            out[name] = value.partition("!")[0].strip()
            if important:
                strong.add(name)
    return out


# States of the walk: in pre, under visibility:hidden, in svg outside of its text.
PRE, UNSEEN, DRAWN = 1, 2, 4


def entered(node: Node, state: int) -> int | None:
    """The state within a node; None if it is not laid out."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return None
    if a.get("style"):
        s = declared(a["style"])
        if s.get("display") == "none" or s.get("content-visibility") == "hidden":
            return None
        if s.get("visibility") in ("hidden", "collapse"):
            state |= UNSEEN
        elif s.get("visibility") in ("visible", "initial"):
            state &= ~UNSEEN
    if node.tag == "svg":
        return state | DRAWN
    if node.tag in ("text", "foreignobject"):
        return state & ~DRAWN
    return state | PRE if node.tag in ("pre", "textarea", "listing", "xmp") else state


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines under construction: pending blank lines, the open line, indents of blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.lead = [""]
        self.mark = ""

    def text(self, data: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(data.split("\n")):
                if i:
                    self.end(0, force=True)
                self._put(part)
            return
        data = data.replace("\xa0", " ") if data.isspace() else data
        folded = _BLANK.sub(" ", data)
        if folded[:1] == " ":
            self.space = True
        core = folded.strip(" ")
        if core:
            self._put((" " if self.space and self.line else "") + core)
            self.space = folded[-1] == " "

    def _put(self, text: str) -> None:
        if text and not self.line:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            lead, self.mark = self.lead[-1][: len(self.lead[-1]) - len(self.mark)] + self.mark, ""
            self.line.append(lead)
        self.line.append(text)

    def whole(self, lines: list[str]) -> None:
        """Lines of a finished block."""
        self.end(1)
        for line in lines:
            self._put(line or " ")
            self.end(0)
        self.end(1)

    def indent(self, mark: str) -> None:
        lead = self.lead[-1] + " " * len(mark)
        self.lead.append(lead if len(lead) <= INDENT else self.lead[-1])
        self.mark = mark if mark.strip() else ""

    def back(self) -> None:
        self.lead.pop()
        self.mark = ""

    def end(self, gap: int, force: bool = False) -> None:
        if self.line or force:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)


def _span(value: str | None, most: int) -> int:
    digits = re.match(r"\s*\+?(\d{1,9})", value or "")
    return min(int(digits[1]), most) if digits else 1


#: A rendering asks for the text below other nodes, and is given it.
Rendering = Generator[tuple[Node, int], str, str]


def _table(table: Node, state: int) -> Generator[tuple[Node, int], str, list[str]]:
    """Stray text and captions first, then head, body and foot with cells padded to their columns."""
    before: list[str] = []
    groups: dict[str, list[list]] = {"thead": [], "tbody": [], "tfoot": []}
    stack = [(c, state, "") for c in reversed(table.children)]
    loose = False  # whether the last group is one of rows that stand in the table itself
    while stack:
        x, here, part = stack.pop()
        if isinstance(x, str):
            if x.strip() and not here & (UNSEEN | DRAWN):
                before.append(" ".join(x.split()))
            continue
        inner = entered(x, here)
        if inner is None or x.tag in ("colgroup", "col"):
            continue
        if x.tag in groups and not part:
            groups[x.tag].append([])
            loose = False
            stack += [(c, inner, x.tag) for c in reversed(x.children)]
        elif x.tag == "tr":
            if not part and not loose:
                groups["tbody"].append([])
                loose = True
            row = []
            for c in x.children:
                if isinstance(c, str):
                    if c.strip() and not inner & (UNSEEN | DRAWN):
                        before.append(" ".join(c.split()))
                elif (deep := entered(c, inner)) is not None:
                    text = yield c, deep
                    if c.tag in ("td", "th"):
                        row.append((text.split("\n"), max(1, _span(c.attrs.get("colspan"), COLSPAN)), _span(c.attrs.get("rowspan"), ROWSPAN)))
                    elif text:
                        before += text.split("\n")
            groups[part or "tbody"][-1].append(row)
        else:
            text = yield x, inner
            before += text.split("\n") if text else []
    return before + _aligned([rows for g in groups.values() for rows in g])


def _aligned(groups: list[list[list[tuple[list[str], int, int]]]]) -> list[str]:
    """Lines of a grid whose columns are shared by all groups of rows; spans end with their group."""
    slots = 0
    placed: list[list[tuple[int, int, list[str]]]] = []
    for rows in groups:
        active: list[tuple[int, int, int]] = []  # first column, end, first row below
        for n, row in enumerate(rows):
            active = [x for x in active if x[2] > n]
            slots += len(active) + len(row)
            if slots > GRID:
                active = []
            at = k = 0
            cells, begun = [], []
            for lines, across, down in row:
                while k < len(active) and active[k][0] <= at:
                    at, k = max(at, active[k][1]), k + 1
                cells.append((at, at + across, lines))
                if down != 1:
                    begun.append((at, at + across, n + down if down else len(rows)))
                at += across
            active = sorted(active + begun) if begun else active
            if any(line for c in cells for line in c[2]):
                placed.append(cells)
    starts = sorted({c[0] for cells in placed for c in cells})
    rank = {c: i for i, c in enumerate(starts)}
    widths = [0] * len(starts)
    ends = {}
    for cells in placed:
        for a, b, lines in cells:
            r = ends.setdefault((a, b), bisect_left(starts, b))
            if r == rank[a] + 1:
                widths[rank[a]] = max(widths[rank[a]], *(w for w in map(width, lines) if w <= PAD), 0)
    upto = [0]
    for w in widths:
        upto.append(upto[-1] + w + 3)
    out = []
    for cells in placed:
        height = max(len(lines) for _, _, lines in cells)
        slots += height * len(cells)
        if slots > GRID:
            out += [line for _, _, lines in cells for line in lines if line]
            continue
        for i in range(height):
            parts, r = [], 0
            for a, b, lines in cells:
                if rank[a] > r:
                    parts += [" " * w for w in widths[r : rank[a]]]
                    slots += rank[a] - r
                r = max(r, ends[a, b])
                text = lines[i] if i < len(lines) else ""
                room = min(upto[ends[a, b]] - upto[rank[a]] - 3, 4 * PAD)
                parts.append(text + " " * (room - width(text)))
            while len(parts) > 1 and not parts[-1].strip():
                parts.pop()
            out.append(" | ".join(parts).rstrip())
    return out


def _rendering(root: Node, state: int) -> Rendering:
    """All visible text below a node."""
    page = Page()
    stack: list[tuple] = [(True, c, state) for c in reversed(root.children)]
    counters: list[list] = []
    while stack:
        opened, x, state = stack.pop()
        if not opened:
            page.end(1 if x.tag in SPACED else 0)
            if x.tag in LISTS:
                counters.pop()
            if x.tag in ("li", "blockquote", "dd"):
                page.back()
            continue
        if isinstance(x, str):
            if not state & (UNSEEN | DRAWN):
                page.text(x, bool(state & PRE))
            continue
        inner = entered(x, state)
        if inner is None:
            continue
        tag, a, seen = x.tag, x.attrs, not inner & (UNSEEN | DRAWN)
        children = x.children
        if tag == "br":
            page.end(0, force=True)
        elif tag == "hr":
            page.end(1)
        elif tag == "img" or tag == "input":
            shown = a.get("alt") if tag == "img" or (a.get("type") or "").lower() == "image" else a.get("value") if (a.get("type") or "text").lower() in SHOWN_INPUTS else None
            if seen and (shown or "").strip():
                page.text(f" {shown.strip()} ", False)
        elif tag == "table":
            page.whole((yield from _table(x, inner)))
        else:
            if tag == "select" and "multiple" not in a and _span(a.get("size"), 1000) <= 1:
                options, found = list(reversed(children)), []
                while options:
                    o = options.pop()
                    if isinstance(o, Node):
                        if o.tag == "option" and entered(o, inner) is not None:
                            found.append(o)
                        options += reversed(o.children)
                children = [*[o for o in found if "selected" in o.attrs][-1:], *found][:1]
            elif tag == "details" and "open" not in a:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            elif tag == "optgroup" and seen and a.get("label"):
                page.end(0)
                page.text(a["label"], False)
            elif tag in ("text", "select", "textarea", "button") and seen:
                page.space = True
            if tag in BLOCK or tag == "optgroup":
                page.end(1 if tag in SPACED and not (tag in LISTS and counters) else 0)
                if tag in LISTS:
                    start = re.match(r"\s*([+-]?\d{1,9})(?!\d)", a.get("start") or "")
                    counters.append([tag, int(start[1]) if start else 1])
                elif tag == "li":
                    kind = counters[-1] if counters else ["ul", 1]
                    own = re.match(r"\s*([+-]?\d{1,9})(?!\d)", a.get("value") or "")
                    kind[1] = int(own[1]) if own and kind[0] == "ol" else kind[1]
                    page.indent((f"{kind[1]}. " if kind[0] == "ol" else "- ") if seen else "  ")
                    kind[1] += 1
                elif tag in ("blockquote", "dd"):
                    page.indent("  ")
                stack.append((False, x, state))
            stack += [(True, c, inner) for c in reversed(children)]
    page.end(0)
    return "\n".join(page.lines).strip("\n")


def render(root: Node) -> str:
    """Runs the renderings that ask for each other, innermost first, without recursion."""
    running, text = [_rendering(root, 0)], None
    while True:
        try:
            running.append(_rendering(*running[-1].send(text)))
            text = None
        except StopIteration as done:
            running.pop()
            text = done.value
            if not running:
                return text


def page_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract_text(pages: DataFrame, html: str = "html", out: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all if None) with the visible text in `out`."""
    keep = [c for c in (pages.columns if carry is None else carry) if c != out]
    schema = pages.select(*keep, F.lit("").cast("string").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(h.as_py()) for h in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, out])

    return pages.mapInArrow(run, schema)
