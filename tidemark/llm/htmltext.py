"""Visible text of web pages, laid out as it would be read.

Method: a tree builder with implied tags keeps a stack of open elements; each block element gathers finished lines and one run
of inline text.  Closing a block hands its lines to the block around it, so the tree is rendered as it is closed and
nesting of any depth needs no recursion.  Blocks start on lines of their own, paragraphs, headings, lists and tables stand
apart by an empty line, list items carry their marker and hang under it, and table cells are padded to the width of their
column.  Invisible are comments, scripts, styles, head, templates, drawings (svg), the annotations of formulas, and whatever is
hidden by attribute or inline style.  The text of formulas (math) is visible.

Cost: open elements are found by name, a block hands its lines up as one part, and indents are written once at the end, so the
time of a page follows its length at any depth.  Two rules of layout bound the output; neither loses text: a line hangs at
most ``INDENT`` columns to the right, and tables more than ``TABLES`` deep put their cells under each other.

Defined results: null and empty pages give empty text; broken markup never fails (a tag without end is closed by the end of
the page, an end tag without start is ignored, except that a line-break end tag breaks the line); repeated rows give the
same text; an empty table gives no rows; other columns may be carried along.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.textmap import over_texts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title datalist object audio video canvas svg annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body div section article nav aside header footer main address center details summary dialog dt dd li form figcaption legend menu search hgroup caption thead tbody tfoot tr td th option optgroup select textarea xmp".split())
#: Start tag: the open elements it closes first, and the elements that this never crosses.
CELLS = frozenset("td th caption".split())
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split()) | CELLS),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"]) | CELLS), "dd": (frozenset("dt dd".split()), frozenset(["dl"]) | CELLS),
    "option": (frozenset(["option"]), frozenset("select optgroup datalist".split())), "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "td": (CELLS, frozenset("tr table".split())), "th": (CELLS, frozenset("tr table".split())),
    "tr": (frozenset("tr td th caption".split()), frozenset("table thead tbody tfoot".split())),
    "thead": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
IMPLIED["tbody"] = IMPLIED["tfoot"] = IMPLIED["thead"]
CLOSES_P = (BLOCK - frozenset("html body td th tr thead tbody tfoot caption option optgroup select textarea".split()), frozenset("button".split()) | CELLS)


#: Greatest hanging indent of a line, in columns.
INDENT = 200
#: Tables open at once whose cells are aligned.
TABLES = 16


class Box:
    """An open block: finished parts, the inline run, and what it is. gap: an empty line is due before the next line.

    A part is a line, or the parts of a child as a list, or those with the prefixes of their first and of their other lines.
    """

    __slots__ = ("name", "serial", "lines", "run", "gap", "hidden", "pre", "rows", "count", "marker", "span")

    def __init__(self, name: str, serial: int, hidden: bool, pre: bool):
        self.name, self.serial, self.lines, self.run, self.gap, self.hidden, self.pre = name, serial, [], [], False, hidden, pre
        self.rows, self.count, self.marker, self.span = [], 0, "", 1

    def flush(self) -> None:
        if not self.run:
            return
        text, self.run = "".join(self.run), []
        if self.pre:
            self.put(text.strip("\n").split("\n"), False)
            return
        lines = [SPACE.sub(" ", x).strip(" ") for x in text.split("\0")]
        while lines and not lines[-1]:
            lines.pop()
        if any(lines):
            self.put(lines, False)

    def put(self, lines: list, apart: bool) -> None:
        """Add parts of a child; apart: with an empty line on both sides."""
        if not lines:
            return
        if self.lines and (self.gap or apart):
            self.lines.append("")
        if self.lines:
            self.lines.append(lines)
        else:
            self.lines = lines
        self.gap = apart


def flat(parts: list) -> list[str]:
    """The lines of parts, prefixed. Empty lines stay empty unless they are the first under a prefix."""
    out, indent, first = [], "", None
    ahead = [(iter(parts), indent)]
    while ahead:
        parts, indent = ahead[-1]
        for x in parts:
            if isinstance(x, str):
                out.append("".join(first) + x if first else indent + x if x else x)
                first = None
            elif isinstance(x, tuple):
                if not first:
                    first = [indent]
                first.append(x[1])
                ahead.append((iter(x[0]), (indent + x[2])[:INDENT]))
                break
            else:
                ahead.append((iter(x), indent))
                break
        else:
            ahead.pop()
    return out


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Lines of a table: cells padded to the width of their column, cells over several columns to all of them."""
    columns = max((sum(s for _, s in r) for r in rows), default=0)
    width = [0] * columns
    for r in rows:
        c = 0
        for lines, s in r:
            if s == 1:
                width[c] = max(width[c], *map(len, lines), 0) if lines else width[c]
            c += s
    out = []
    for r in rows:
        for k in range(max((len(x) for x, _ in r), default=0)):
            c, parts = 0, []
            for lines, s in r:
                parts.append((lines[k] if k < len(lines) else "").ljust(sum(width[c:c + s]) + 2 * (s - 1)))
                c += s
            out.append("  ".join(parts).rstrip())
    return out


class Page:
    def __init__(self):
        self.boxes = [Box("", 0, False, False)]
        #: Open elements: name, whether it is a block, whether it hides, whether it keeps white space, serial number.
        self.open: list[tuple[str, bool, bool, bool, int]] = []
        #: Serial numbers of the open elements of each name, and of those already ended inside a later block.
        self.serials: dict[str, list[int]] = {}
        self.ended: set[int] = set()
        self.blocks: set[int] = set()
        #: Open blocks that others look for, by name.
        self.held: dict[str, list[Box]] = {x: [] for x in ("ul", "ol", "menu", "tr", "table")}
        self.made = 0

    def last(self, names) -> int:
        """Serial number of the innermost open element of these names, 0 if there is none."""
        return max((x[-1] for n in names if (x := self.serials.get(n))), default=0)

    def holder(self, *names: str) -> Box | None:
        return max((x[-1] for n in names if (x := self.held[n])), key=lambda b: b.serial, default=None)

    def close_from(self, serial: int) -> None:
        while self.open and self.open[-1][4] >= serial:
            self.close()

    def close(self) -> None:
        name, block, _, _, serial = self.open.pop()
        if serial in self.ended:
            self.ended.remove(serial)
            return
        self.serials[name].pop()
        if not block:
            return
        self.blocks.remove(serial)
        box = self.boxes.pop()
        if name in self.held:
            self.held[name].pop()
        if box.hidden:
            return
        box.flush()
        above = self.boxes[-1]
        above.flush()
        if name in ("td", "th"):
            holder = self.holder("tr", "table")
            if holder is not None and len(self.held["table"]) <= TABLES:
                if holder.name == "table" and not holder.rows:
                    holder.rows.append([])
                (holder.rows[-1] if holder.name == "table" else holder.rows).append((flat(box.lines), box.span))
                return
        if name == "tr":
            table = self.holder("table")
            if table is not None:
                if box.rows:
                    table.rows.append(box.rows)
                above.put(box.lines, False)
                return
            box.put(aligned([box.rows]) if box.rows else [], False)
        if name == "table" and box.rows:
            box.put(aligned(box.rows), False)
        if name in ("li", "dd", "blockquote") and box.lines:
            box.lines = [(box.lines, box.marker, " " * len(box.marker)) if name == "li" else (box.lines, "  ", "  ")]
        nested = name in ("ul", "ol") and above.name == "li"
        above.put(box.lines, name in SPACED and not nested)

    def close_to(self, names: frozenset, stop: frozenset) -> None:
        """Close up to the outermost element of ``names`` that is open above any of ``stop``."""
        open_ = [x for n in names if (x := self.serials.get(n))]
        if open_:
            edge = self.last(stop)
            found = min((x[i] for x in open_ if (i := bisect_right(x, edge)) < len(x)), default=0)
            if found:
                self.close_from(found)

    def start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P[0]:
            self.close_to(frozenset(["p"]), CLOSES_P[1])
        if name in IMPLIED:
            self.close_to(*IMPLIED[name])
        box = self.boxes[-1]
        if name in VOID:
            if name == "br" and not box.hidden:
                box.run.append("\n" if box.pre else "\0")
            elif name == "hr":
                box.flush()
                box.gap = bool(box.lines)
            return
        attrs = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        while self.open and self.open[-1][4] in self.ended:
            self.close()
        state = self.open[-1] if self.open else ("", False, False, False, 0)
        hides = state[2] or name in UNSEEN or "hidden" in attrs or bool(attrs.get("style") and HIDING.search(attrs["style"]))
        pre = state[3] or name in ("pre", "textarea", "xmp")
        block = name in BLOCK or hides and not state[2]
        self.made += 1
        self.open.append((name, block, hides, pre, self.made))
        self.serials.setdefault(name, []).append(self.made)
        if block:
            self.blocks.add(self.made)
            if not hides:
                box.flush()
            new = Box(name, self.made, hides, pre)
            if name == "li":
                holder = self.holder("ul", "ol", "menu")
                if holder is not None and holder.name == "ol":
                    value = attrs.get("value", "")
                    holder.count = int(value) if value.isascii() and value.isdigit() and len(value) < 10 else holder.count + 1
                    new.marker = f"{holder.count}. "
                else:
                    new.marker = "- "
            elif name == "ol":
                value = attrs.get("start", "")
                new.count = int(value) - 1 if value.isascii() and value.isdigit() and len(value) < 10 else 0
            elif name in ("td", "th"):
                value = attrs.get("colspan", "")
                new.span = min(max(1, int(value)), 1000) if value.isascii() and value.isdigit() and len(value) < 10 else 1
            self.boxes.append(new)
            if name in self.held:
                self.held[name].append(new)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
            return
        stop = frozenset() if name in ("table", "html", "body") else frozenset(["table"]) if name in CELLS or name in ("tr", "thead", "tbody", "tfoot") else CELLS | {"table"}
        serial = self.last([name])
        if not serial or self.last(stop) > serial:
            return
        if serial not in self.blocks and self.boxes[-1].serial > serial:
            self.serials[name].pop()  # an inline element ends inside a later block: that block stays open
            self.ended.add(serial)
        else:
            self.close_from(serial)

    def text(self, raw: str) -> None:
        box = self.boxes[-1]
        while self.open and self.open[-1][4] in self.ended:
            self.close()
        if not box.hidden and not (self.open and self.open[-1][2]):
            box.run.append(unescape(raw).replace("\0", "�") if "&" in raw or "\0" in raw else raw)


def render(html: str) -> str:
    page, at = Page(), 0
    for m in iter(lambda: TOKEN.search(html, at), None):
        if m.start() > at:
            page.text(html[at:m.start()])
        at, name = m.end(), m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            page.end(name)
            continue
        page.start(name, m[3])
        if name in RAW:
            stop = re.compile(f"</{name}(?=[\\s/>]|$)", re.I).search(html, at)
            stop_at = stop.start() if stop else len(html)
            if name in ("textarea", "xmp"):
                page.text(html[at:stop_at])
            at = stop_at
    page.text(html[at:])
    while page.open:
        page.close()
    page.boxes[0].flush()
    return "\n".join(flat(page.boxes[0].lines))


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",), name: str = "text") -> DataFrame:
    """Columns ``keep`` and the visible text."""
    return over_texts(df, html, list(keep), f"{name} string", lambda: lambda pages: [pa.array([render(x or "") for x in pages.to_pylist()], pa.string())])
