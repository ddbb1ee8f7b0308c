"""HTML extraction: a layout-aware rendering of a page's visible text.

A small tree builder reads tags and text, supplies the tags that HTML lets authors omit (ends, and rows around cells),
ignores stray ones, and puts what stands in a table outside its cells before the table. The renderer then walks the tree:
it leaves out what a browser doesn't show (head, scripts, `hidden`, closed details and dialogs, what is styled so),
collapses white space outside pre, separates paragraphs, lists, tables and headings by empty lines and other blocks by
line ends, marks, numbers and indents list items, and sets table cells in aligned columns (colspan and rowspan are kept
to the grid).

Styles are those of style attributes and of simple selectors (element, .class, #id) in the page's own sheets for screens
of any size; sheets that a browser doesn't apply (in noscript or template) don't count. Of display and of visibility the
declaration that is important, or else inline, or else of the more special selector, or else the last one holds. A child
may be visible in a parent that isn't, but not in one that has no display. Reading and rendering take time in proportion
to the page and to the text given: indents stop at 40 columns, and tables in 15 others are rendered as blocks.

Cases: null and empty pages have empty text; text without tags is one paragraph; unclosed tags and comments run to the
end; elements may be nested to any depth; a cell spans at most 1,000 columns and 65,534 rows, as in HTML; repeated rows
are rendered each; an empty table gives no rows; an existing column of the result's name is replaced, others stay.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Elements by their part in parsing and layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noscript meta link base iframe noembed noframes object audio video canvas datalist map param source track rp".split())
IN_HEAD = frozenset("title meta link base script style noscript template head html".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav aside main address form fieldset li dt dd figcaption details summary dialog center legend caption tr thead tbody tfoot td th menu hgroup search option optgroup".split())
#: The end tags that a start tag implies, and the elements at which the search for them stops.
LISTS, CELLS, TABLE = ("ul", "ol", "menu"), ("td", "th", "caption"), ("table",)
SECTIONS = ("thead", "tbody", "tfoot")
#: What stays in a table where it stands outside cells.
IN_TABLE = frozenset([*SECTIONS, "tr", *CELLS, "colgroup", "col", "script", "style", "template"])
#: Where the part of a table goes: the open elements above these end.
CONTEXT = {"td": ("tr", *SECTIONS, *TABLE), "th": ("tr", *SECTIONS, *TABLE), "tr": (*SECTIONS, *TABLE), **dict.fromkeys((*SECTIONS, "caption", "colgroup"), TABLE)}
INNER = (*CELLS, *TABLE)
IMPLIED = {
    "li": (("li",), (*LISTS, *INNER)), "dt": (("dt", "dd"), ("dl", *INNER)), "dd": (("dt", "dd"), ("dl", *INNER)), "option": (("option",), ("select", *INNER)), "optgroup": (("option", "optgroup"), ("select", *INNER)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "caption", "colgroup"), TABLE),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), TABLE), "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), TABLE), "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), TABLE),
}
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]+))?")
_PART = re.compile(r"([^{}]*)([{}])")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?\s*(?=;|\Z)", re.I)
#: Columns of indent beyond which deeper items aren't indented further.
DEEPEST = 40
#: Tables in tables beyond which cells are blocks, and pre in such is text as it stands.
INSIDE = 16
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    return out


def parse(page: str) -> Node:
    """The page's tree. Text is a str among the children."""
    root = Node("html", {})
    stack, at = [root], 0
    where: defaultdict[str, list[int]] = defaultdict(list)  # of each tag the places in the stack

    def last(tags) -> int:
        return max((where[t][-1] for t in tags if where[t]), default=0)

    def cut(size: int) -> None:
        while len(stack) > size:
            where[stack.pop().tag].pop()

    def open_(node: Node) -> None:
        where[node.tag].append(len(stack))
        stack.append(node)

    def close(tags, stops=()) -> None:
        """Ends the innermost of the tags and all in it, unless one of the stops lies further in."""
        i = last(tags)
        if i and i >= last(stops):
            cut(i)

    def put(node: Node | str):
        """Into the open element; what may not stand there in a table goes before the table."""
        if stack[-1].tag in ("table", *SECTIONS, "tr") and (node.strip() if isinstance(node, str) else node.tag not in IN_TABLE):
            i = last(TABLE)
            if not i:
                return stack[-1].children.append(node)
            stack[i - 1].children.insert(_place(stack[i - 1].children, stack[i]), node)
        else:
            stack[-1].children.append(node)

    def say(text: str) -> None:
        if text:
            if stack[-1].tag == "head" and text.strip():
                close(("head",))
            put(html.unescape(text))

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                put(Node("br", {}))
            elif tag not in ("html", "body"):
                close((tag,), () if tag == "table" else TABLE if tag in ("tr", "td", "th", *SECTIONS) else INNER)
            continue
        if tag in ("html", "body"):
            close(("head",))
            (stack[0].attributes if tag == "html" else root.attributes).update(_attributes(m[3]) if tag == "body" else {})
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close(("head",))
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in CLOSES_P:
            close(("p",), (*INNER, "button"))
        if tag in CONTEXT:
            # Ends what is open inside the table but outside cells; outside tables the tag stands where it is.
            i = last((*CONTEXT[tag], *CELLS))
            if i and stack[i].tag not in CELLS:
                cut(i + 1)
                if tag in ("td", "th") and stack[i].tag != "tr":
                    stack[i].children.append(Node("tr", {}))
                    open_(stack[i].children[-1])
        while tag == "table" and stack[-1].tag in ("table", *SECTIONS, "tr") and where["table"]:
            close(TABLE)
        if tag == "form" and stack[-1].tag in ("table", *SECTIONS, "tr"):
            continue
        node = Node(tag, _attributes(m[3]))
        put(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            text = page[at : end.start() if end else len(page)]
            node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag not in VOID and tag in BLOCK:
            open_(node)
    return root


def _place(children: list, table: Node) -> int:
    """Where the table stands: the last place, or one near it."""
    return next(i for i in range(len(children) - 1, -1, -1) if children[i] is table)


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]


def _for_screens(rule: str) -> bool:
    """Whether a grouping rule holds on any screen: media by type alone, and supports or layers."""
    name, _, media = rule.strip().lower().partition(" ")
    if not name.startswith("@media"):
        return name.startswith(("@supports", "@layer"))
    kinds = [" ".join(k.split()) for k in (name[6:] + " " + media).split(",")]
    return any(k in ("", "all", "screen", "only screen", "only all", "not print", "not speech") for k in kinds)


def _said(style: str) -> Iterator[tuple[str, bool, bool]]:
    """display or visibility, whether it is off, and whether that is important, of each declaration."""
    for name, value, important in _STYLE.findall(style):
        yield name.lower(), value.lower() in (("none",) if name.lower() == "display" else ("hidden", "collapse")), bool(important)


#: Of what stands in them no sheet is applied.
NO_SHEETS = frozenset(("noscript", "template", "iframe", "noembed", "noframes", "textarea", "title", "xmp"))


def _sheets(root: Node) -> dict[str, dict[str, tuple]]:
    """For display and visibility: of each simple selector the strongest declaration, as (rank, off)."""
    found: dict[str, dict[str, tuple]] = {"display": {}, "visibility": {}}
    todo, number = [root], 0
    while todo:
        n = todo.pop()
        if n.tag in NO_SHEETS:
            continue
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
        if n.tag != "style" or not n.children or "media" in n.attributes and not _for_screens("@media " + n.attributes["media"]):
            continue
        holds, head = [True], ""
        for text, mark in _PART.findall(re.sub(r"/\*.*?\*/", "", n.children[0], flags=re.S)):
            if mark == "{":
                head = text.rpartition(";")[2].strip()
                holds.append(holds[-1] and (not head.startswith("@") or _for_screens(head)))
            else:
                if len(holds) > 1 and holds.pop() and not head.startswith("@"):
                    for name, off, important in _said(text):
                        for x in head.split(","):
                            x, number = x.strip(), number + 1
                            if re.fullmatch(r"[.#]?[\w-]+|\*", x):
                                x = x if x[0] in ".#" else x.lower()
                                rank = (important, {".": 2, "#": 3, "*": 0}.get(x[0], 1), number)
                                found[name][x] = max(found[name].get(x, ((False, -1, 0), False)), (rank, off))
                head = "@"  # what ends next is a group
    return found


class Level:
    """A list item or quotation that lines are written in: what stands before its first line; the others have as many blanks."""

    __slots__ = ("first", "used", "gap")

    def __init__(self, first: str, gap: int):
        self.first, self.used, self.gap = first, False, gap


class Lines:
    """Text under layout: lines, and how many empty ones must come before the next text."""

    def __init__(self):
        self.lines, self.line, self.gap, self.space = [], "", 0, False
        self.levels, self.fresh = [], []  # fresh: the levels without a line yet, innermost last
        self.width, self.waiting = 0, 0  # columns of indent of all levels, and of those

    def text(self, raw: str) -> None:
        flat = _SPACES.sub(" ", raw)
        if not flat:
            return
        if flat[0] == " ":
            self.space, flat = True, flat[1:]
        if not flat:
            return
        if not self.line:
            self.space = False
        self.line += (" " if self.space else "") + flat.rstrip(" ")
        self.space = flat[-1] == " "

    def end(self) -> None:
        """Ends the line, if there is text on it."""
        if self.line:
            self.put(self.line)
        self.line, self.space = "", False

    def put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        marks, width = "".join(x.first for x in self.fresh), self.width - self.waiting
        for x in self.fresh:
            x.used = True
        self.fresh, self.waiting = [], 0
        lead = " " * min(width, DEEPEST)
        self.lines.append((lead + marks + line).rstrip(" ") if self.levels else line)

    def block(self, gap: int) -> None:
        self.end()
        if not self.fresh or self.fresh[-1] is not self.levels[-1]:
            self.gap = max(self.gap, gap)

    def enter(self, first: str) -> None:
        level = Level(first, self.gap)
        self.levels.append(level)
        self.fresh.append(level)
        self.width += len(first)
        self.waiting += len(first)

    def leave(self) -> None:
        self.end()
        level = self.levels.pop()
        self.width -= len(level.first)
        if level.used:
            self.gap = 0
        else:
            self.fresh.pop()
            self.waiting -= len(level.first)
            self.gap = level.gap


class Frame:
    """An element whose children are being rendered."""

    __slots__ = ("node", "at", "pre", "seen", "closed", "list", "number", "step", "after")

    def __init__(self, node: Node, pre: bool, seen: bool, above: Frame | None, after=None):
        self.node, self.at, self.pre, self.seen, self.after = node, 0, pre, seen, after
        self.closed = node.tag == "details" and "open" not in node.attributes
        self.list = self if node.tag in LISTS else above.list if above else None
        self.number, self.step = None, -1 if node.tag == "ol" and "reversed" in node.attributes else 1


def _whole(value: str | None) -> int | None:
    return int(value) if re.fullmatch(r"\s*[-+]?\d{1,9}\s*", value or "") else None


def _items(n: Node) -> int:
    """Items of a list, without those of lists in it."""
    todo, found = [n], 0
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                found += c.tag == "li"
                if c.tag not in LISTS:
                    todo.append(c)
    return found


class Renderer:
    def __init__(self, root: Node):
        self.sheets, self.nested = _sheets(root), 0

    def off(self, n: Node, name: str) -> bool | None:
        """Whether display or visibility is off by the page's styles; None if they don't say."""
        best, a = ((False, -1, 0), None), n.attributes
        sheet = self.sheets[name]
        if sheet:
            for x in ("*", n.tag, *("." + c for c in a.get("class", "").split()), "#" + a.get("id", "")):
                if x in sheet:
                    best = max(best, sheet[x], key=lambda r: r[0])
        if "style" in a:
            for k, (said, off, important) in enumerate(_said(a["style"])):
                if said == name:
                    best = max(best, ((important, 4, k), off), key=lambda r: r[0])
        return best[1]

    def hidden(self, n: Node) -> bool:
        if n.tag in UNSEEN or n.tag == "input":
            return True
        off = self.off(n, "display")
        return ("hidden" in n.attributes or n.tag == "dialog" and "open" not in n.attributes) if off is None else off

    def seen(self, n: Node, above: bool) -> bool:
        off = self.off(n, "visibility")
        return above if off is None else not off

    def render(self, n: Node, pre: bool = False, seen: bool = True) -> list[str]:
        out = Lines()
        self.nested += 1
        self.inside(n, out, pre, seen)
        self.nested -= 1
        out.end()
        return out.lines

    def inside(self, n: Node, out: Lines, pre: bool = False, seen: bool = True) -> None:
        frames = [Frame(n, pre, seen, None)]
        while frames:
            f = frames[-1]
            if f.at == len(f.node.children):
                frames.pop()
                if f.after:
                    f.after()
                continue
            c = f.node.children[f.at]
            f.at += 1
            if isinstance(c, str):
                if f.seen and not f.closed:
                    self.say(c, out, f.pre)
                continue
            if self.hidden(c) or f.closed and c.tag != "summary":
                continue
            seen = self.seen(c, f.seen)
            if c.tag == "br":
                if out.line:
                    out.end()
                elif seen:
                    out.put("")
            elif c.tag == "table" and self.nested < INSIDE:
                out.block(1)
                for line in self.table(c, seen):
                    out.put(line)
                out.block(1)
            elif c.tag == "hr":
                out.block(1)
            elif c.tag == "li":
                self.open(frames, c, out, seen, self.mark(c, f.list), 0)
            elif c.tag in ("dd", "blockquote"):
                self.open(frames, c, out, seen, "    ", int(c.tag == "blockquote"))
            elif c.tag in BLOCK:
                gap = int(c.tag in SPACED and not (c.tag in LISTS and f.node.tag in ("li", *LISTS)))
                out.block(gap)
                if c.tag == "pre" and self.nested < INSIDE:
                    for line in self.pre(c, seen):
                        out.put(line)
                    out.block(gap)
                else:
                    frames.append(Frame(c, f.pre or c.tag == "pre", seen, f, lambda gap=gap: out.block(gap)))
            else:
                frames.append(Frame(c, f.pre or c.tag == "textarea", seen, f))

    def say(self, text: str, out: Lines, pre: bool) -> None:
        if not pre:
            return out.text(text)
        first, *rest = text.replace("\r\n", "\n").split("\n")
        out.line += first
        for line in rest:
            out.put(out.line)
            out.line = line

    def pre(self, n: Node, seen: bool) -> list[str]:
        lines = self.render(n, True, seen)
        return lines[1:] if lines and not lines[0] else lines

    def mark(self, item: Node, of: Frame | None) -> str:
        """What stands before an item of the list around it."""
        if of is None:
            return "- "
        if of.number is None:
            start = _whole(of.node.attributes.get("start"))
            of.number = start if start is not None else _items(of.node) if of.step < 0 else 1
        value = _whole(item.attributes.get("value"))
        of.number = of.number if value is None else value
        of.number += of.step
        return f"{of.number - of.step}. " if of.node.tag == "ol" else "- "

    def open(self, frames: list[Frame], n: Node, out: Lines, seen: bool, first: str, gap: int) -> None:
        """An item or a quotation, indented."""
        out.block(gap)
        out.enter(first)

        def after():
            out.leave()
            out.block(gap)

        frames.append(Frame(n, False, seen, frames[-1], after))

    def rows(self, n: Node, seen: bool) -> Iterator[tuple[Node, int, bool]]:
        """Rows, each with the number of rows to the end of its section, and whether it is visible."""
        own = [c for c in n.children if isinstance(c, Node) and not self.hidden(c)]
        left = sum(c.tag == "tr" for c in own)
        for c in own:
            if c.tag == "tr":
                yield c, left, self.seen(c, seen)
                left -= 1
            elif c.tag in SECTIONS:
                yield from self.rows(c, self.seen(c, seen))

    def table(self, n: Node, seen: bool = True) -> list[str]:
        """Cells in columns two spaces apart, after the caption."""
        before = Node("div", {})
        before.children = [c for c in n.children if isinstance(c, Node) and c.tag == "caption"]
        out, grid, busy = self.render(before, seen=seen), [], {}
        for r, (row, left, shown) in enumerate(self.rows(n, seen)):
            line, col = {}, 0
            for cell in row.children:
                if not isinstance(cell, Node) or cell.tag not in ("td", "th") or self.hidden(cell):
                    continue
                while busy.get(col, 0) > r:
                    col += 1
                span = lambda k, c=cell: int(c.attributes[k][-6:]) if re.fullmatch(r"0*\d{1,6}", c.attributes.get(k, "")) else 1
                wide, tall = min(span("colspan") or 1, 1_000), min(span("rowspan") or left, 65_534)
                line[col] = (wide, self.render(cell, seen=self.seen(cell, shown)))
                for k in range(col, col + wide):
                    busy[k] = r + tall
                col += wide
            grid.append(line)
        width: dict[int, int] = {}
        for line in grid:
            for col, (wide, text) in line.items():
                if wide == 1:
                    width[col] = max(width.get(col, 0), *map(len, text or [""]))
        for line in grid:
            for col, (wide, text) in sorted(line.items()):
                if wide > 1:
                    spare = max(map(len, text or [""])) - sum(width.get(k, 0) for k in range(col, col + wide)) - 2 * (wide - 1)
                    width[col + wide - 1] = width.get(col + wide - 1, 0) + max(spare, 0)
        starts, at = {}, 0
        for col in range(max([-1, *width, *(c for line in grid for c in line)]) + 1):
            starts[col] = at
            at += width.get(col, 0) + 2 * (width.get(col, 0) > 0)
        for line in grid:
            for i in range(max([0, *(len(text) for _, text in line.values())])):
                text = ""
                for col, (_, parts) in sorted(line.items()):
                    if i < len(parts) and parts[i]:
                        text = text.ljust(starts[col]) + parts[i]
                out.append(text.rstrip(" "))
        return out


def extract(page: str | None) -> tuple[str, str]:
    """Title and visible text."""
    root = parse(page or "")
    title = next((_SPACES.sub(" ", "".join(c for c in n.children if isinstance(c, str))).strip() for n in _walk(root) if n.tag == "title"), "")
    r = Renderer(root)
    if r.hidden(root):
        return title, ""
    return title, "\n".join(line.rstrip(" ") for line in r.render(root, seen=r.seen(root, True))).strip("\n")


def extract_text(pages: DataFrame, column: str = "html", name: str = "page") -> DataFrame:
    """pages with the struct `name`: title, text."""
    import pandas as pd

    bound_batches(pages.sparkSession)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([extract(x) for x in part], columns=["title", "text"])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return pages.withColumn(name, F.pandas_udf(run, "title string, text string")(column))
