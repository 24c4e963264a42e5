"""Layout-aware HTML extraction.

A tree builder reads tags, character references, comments and raw text, implies the tags
that HTML lets authors leave out (html, head, body, tbody, tr, and the ends of p, li, dt,
dd, option, rows and cells), and ignores ends that match nothing.  Rules of visibility drop
what a page doesn't show: head, script, style, template and the like, ``hidden``,
``display:none``, ``visibility:hidden`` (a descendant may be visible again), closed details
and dialogs, hidden inputs; in attributes and in the page's own style sheets, of which rules
for an element, class or id or a list of those are read (others, and media rules, are not).
The renderer then emits all visible text: paragraphs and
headings set off by a blank line, lists with bullets or numbers and indents, preformatted
text as it is, formulas and the text of drawings in the line, and tables as rows of cells that
are aligned in columns; a cell that spans rows or columns holds its place in all of them.

Trees are walked with a stack of their own, so nesting may be as deep as the page has it.
Every cell is as wide as its longest line; where ``widest`` is given, longer lines are broken at
blanks inside their column.  Defined results: null and empty pages give an empty text; broken
markup never fails; repeated pages give equal texts; other columns, whatever their names, are
not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import bounded_batches

#: Widest colspan and longest rowspan that HTML honours.
SPAN, ROWSPAN = 1000, 65_534

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript template title textarea".split())
UNSEEN = set("head script style template noscript iframe noembed noframes title meta link base object audio video canvas datalist param source track area map defs metadata annotation annotation-xml".split())
HEAD_ONLY = set("title meta link base style script noscript template".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table pre xmp blockquote figure hr fieldset".split())
LISTS = set("ul ol menu dir".split())
SECTIONS = set("tbody thead tfoot".split())
#: What an opening tag ends, if it is open within the scope that the second set bounds.
ENDS = {
    **dict.fromkeys(BLOCK - {"body", "html", "option", "optgroup"}, ({"p"}, {"td", "th", "table", "button", "caption"})),
    "li": ({"li", "p"}, LISTS | {"td", "th", "table"}),
    "dt": ({"dt", "dd", "p"}, {"dl", "td", "th", "table"}),
    "dd": ({"dt", "dd", "p"}, {"dl", "td", "th", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table"}),
    "th": ({"td", "th", "caption"}, {"table"}),
    **dict.fromkeys(SECTIONS, (SECTIONS | {"tr", "td", "th", "caption", "colgroup"}, {"table"})),
    "a": ({"a"}, {"td", "th", "table", "button", "caption"}),
}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+|[\"'])*+)(?:>|\Z)|[^<]++|<", re.S
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("html", {})
    stack, body = [root], None
    at, n = 0, len(page)
    opened: dict[str, int] = {}  # how many elements of a name are open: most searches end there

    def cut(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    def within(names: set[str], bound: set[str]) -> int:
        """The lowest place in the stack of one of the names, above the nearest bound; 0 for none."""
        found = 0
        if not any(map(opened.get, names)):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in bound:
                break
            if stack[k].tag in names:
                found = k
        return found

    def push(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
        return node

    def into_body() -> None:
        """Ends the head and implies the body."""
        nonlocal body
        if body is None:
            cut(1)
            body = push("body", {})

    while at < n:
        m = _TOKEN.match(page, at)
        at, name = m.end(), m["name"]
        if name is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1:
                continue
            if body is None and text.strip(" \t\n\f\r"):
                into_body()
            if body is not None:
                stack[-1].children.append(html.unescape(text) if "&" in text else text)
            continue
        name = name.lower()
        if m["end"]:
            if name in ("html", "body", "head"):
                if name == "head" and body is None:
                    cut(1)
                continue
            bound = set() if name == "table" else {"table"} if name in SECTIONS or name in ("tr", "td", "th") else {"td", "th", "table", "caption"}
            for k in range(len(stack) - 1, 0, -1) if opened.get(name) else ():
                if stack[k].tag == name:
                    cut(k)
                    break
                if stack[k].tag in bound:
                    break
            if name == "br":
                into_body()
                stack[-1].children.append(Node("br", {}))
            continue
        attrs = _attributes(m["attrs"]) if m["attrs"] else {}
        if name == "html":
            root.attrs = attrs | root.attrs
            continue
        if name == "head":
            if body is None and len(stack) == 1:
                push("head", attrs)
            continue
        if name == "body":
            if body is None:
                into_body()
                body.attrs = attrs
            continue
        if body is None and name not in HEAD_ONLY:
            into_body()
        if name in ENDS:
            names, bound = ENDS[name]
            if k := within(names, bound):
                cut(k)
        if name in ("td", "th") and stack[-1].tag in SECTIONS | {"table"}:
            if stack[-1].tag == "table":
                push("tbody", {})
            push("tr", {})
        elif name == "tr" and stack[-1].tag == "table":
            push("tbody", {})
        node = push(name, attrs)
        if name in VOID or (m["attrs"] or "").endswith("/") and name not in BLOCK and name not in RAW and name not in ("td", "th", "tr", "span", "a", "b", "i"):
            cut(len(stack) - 1)
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            text = page[at : close.start() if close else n]
            if name in ("textarea", "title"):
                text = html.unescape(text)
            node.children.append(text)
            cut(len(stack) - 1)
            at = close.start() if close else n
            if close:
                at = page.find(">", close.end()) + 1 or n
    return root


def _style(node: Node) -> str:
    return _SPACE.sub("", node.attrs.get("style", "")).lower()


_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([a-z][a-z0-9-]*)?(?:([.#])([\w-]+))?", re.I)
#: Of a rule, what decides visibility.
_SEEN = re.compile(r"(?:^|;)(display|visibility):([a-z-]+)(!important)?")

Sheet = dict[tuple[str, str, str], list[tuple[tuple[bool, int, int], str, str]]]


def style_sheet(root: Node) -> Sheet:
    """Rules that decide visibility, by (element, "." or "#", name): each with its weight
    (importance, kind, order), property and value."""
    sheet: Sheet = {}
    stack, order = [root], 0
    while stack:
        node = stack.pop()
        if node.tag == "style":
            text = re.sub(r"/\*.*?(?:\*/|\Z)", "", "".join(c for c in node.children if isinstance(c, str)), flags=re.S)
            text = re.sub(r"@[^{;]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*(?:\}|\Z))", "", text)
            for selectors, body in _RULE.findall(text):
                found = _SEEN.findall(_SPACE.sub("", body).lower())
                for one in selectors.split(",") if found else ():
                    m = _SIMPLE.fullmatch(one.strip())
                    if m and m[0]:
                        order += 1
                        key = ((m[1] or "").lower(), m[2] or "", m[3] or "")
                        kind = (m[2] == "#") * 4 + (m[2] == ".") * 2 + bool(m[1])
                        sheet.setdefault(key, []).extend(((bool(strong), kind, order), what, value) for what, value, strong in found)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return sheet


def _ruled(node: Node, sheet: Sheet) -> dict[str, str]:
    """display and visibility of an element by the style sheet and its own style."""
    marks = [("", "")] + [(".", c) for c in node.attrs.get("class", "").split()] + ([("#", node.attrs["id"])] if "id" in node.attrs else [])
    rules = [r for element in ("", node.tag) for mark, name in marks for r in sheet.get((element, mark, name), ())] if sheet else []
    if "style" in node.attrs:
        rules += [((bool(strong), 8, 0), what, value) for what, value, strong in _SEEN.findall(_style(node))]
    return {what: value for _, what, value in sorted(rules)}


def _shown(node: Node, visible: bool, sheet: Sheet) -> tuple[bool, bool]:
    """Whether the element is laid out, and whether its own text is visible."""
    attrs, tag = node.attrs, node.tag
    if tag in UNSEEN or tag == "input" or tag == "dialog" and "open" not in attrs:
        return False, False
    ruled = _ruled(node, sheet) if sheet or "style" in attrs else {}
    if ruled.get("display") == "none" or "hidden" in attrs and "display" not in ruled:
        return False, False
    if "visibility" in ruled and ruled["visibility"] not in ("inherit", "unset"):
        visible = ruled["visibility"] not in ("hidden", "collapse")
    return True, visible


def _number(node: Node, name: str, most: int) -> int:
    """A span of a cell; 1 if it isn't a number."""
    text = node.attrs.get(name, "1").strip()
    return min(most, int(text)) if re.fullmatch(r"\d{1,9}", text) else 1


class Lines:
    """Lines of text; blocks ask for line ends and blank lines, which come when text does."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = self.space = False

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *more = text.replace("\r\n", "\n").split("\n")
            if first:
                self._put(first)
            for line in more:
                self.end(True)
                if line:
                    self._put(line)
            return
        flat = _SPACE.sub(" ", text)
        if not flat.strip(" "):
            self.space = self.space or bool(flat and self.parts)
            return
        if (flat[0] == " " or self.space) and self.parts:
            self.parts.append(" ")
        self.space = flat[-1] == " "
        self._put(flat.strip(" "))

    def _put(self, text: str) -> None:
        if self.blank and self.lines and not self.parts:
            self.lines.append("")
        self.blank = False
        self.parts.append(text)

    def end(self, always: bool = False) -> None:
        if self.parts or always:
            self.lines.append("".join(self.parts).rstrip())
        self.parts, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end()
        self.blank = self.blank or spaced

    def add(self, lines: list[str], spaced: bool) -> None:
        """Lines of a box of their own."""
        self.block(spaced)
        if lines and self.blank and self.lines:
            self.lines.append("")
        if lines:
            self.blank = False
        self.lines += lines
        self.block(spaced)

    def done(self) -> list[str]:
        self.end()
        out = self.lines
        while out and not out[0]:
            out.pop(0)
        while out and not out[-1]:
            out.pop()
        return out


@dataclass
class Cell:
    """A cell's lines, how many columns and rows it spans (0: all further rows), whether it is right-aligned."""

    lines: list[str]
    columns: int
    rows: int
    right: bool


def _broken(line: str, most: int) -> list[str]:
    """A line broken at blanks to at most so many characters, longer words by themselves."""
    out = [""]
    for word in line.split(" "):
        if out[-1] and len(out[-1]) + 1 + len(word) > most:
            out.append(word)
        else:
            out[-1] = f"{out[-1]} {word}" if out[-1] else word
    return out


def placed(rows: list[list[Cell]]) -> list[list[tuple[int, Cell]]]:
    """Each row's cells with their columns: a cell that spans rows holds its columns in those below.
    An empty cell only stands where one that spans rows doesn't."""
    out: list[list[tuple[int, Cell]]] = []
    held: dict[int, int] = {}  # column: last row that is held
    for at, row in enumerate(rows):
        held = {c: last for c, last in held.items() if last >= at}
        k, line = 0, []
        for cell in row:
            while k in held:
                k += 1
            line.append((k, cell))
            if cell.rows != 1:
                last = at + cell.rows - 1 if cell.rows else len(rows)
                held.update((c, max(last, held.get(c, 0))) for c in range(k, k + cell.columns))
            k += cell.columns
        out.append(line)
    return out


def _table(rows: list[list[Cell]], widest: int | None) -> list[str]:
    """Rows of cells as aligned lines."""
    grid = placed(rows)
    if widest:
        for row in rows:
            for cell in row:
                cell.lines = [x for line in cell.lines for x in ([line] if len(line) <= widest else _broken(line, widest))]
    width: dict[int, int] = {}
    for row in grid:
        for k, cell in row:
            if cell.columns == 1:
                width[k] = max(width.get(k, 0), max(map(len, cell.lines), default=0))
    # A cell of more columns widens the last that has a width of its own, if they are too narrow.
    for row in grid:
        for k, cell in row:
            if cell.columns > 1:
                own = [c for c in range(k, k + cell.columns) if c in width] or [k]
                short = max(map(len, cell.lines), default=0) - sum(width.get(c, 0) for c in own) - 3 * (len(own) - 1)
                if short > 0:
                    width[own[-1]] = width.get(own[-1], 0) + short
    columns = sorted(width)
    start, room = {}, 0
    for c in columns:
        start[c] = room
        room += width[c] + 3
    out = []
    for row in grid:
        for i in range(max((len(cell.lines) for _, cell in row), default=0)):
            line, todo = "", iter(columns)
            for k, cell in row:
                own = [c for c in range(k, k + cell.columns) if c in width]
                if not own:
                    continue
                # Columns before the cell that a cell above holds stay blank.
                for c in todo:
                    line = line.ljust(start[c] - 3) + " | " if start[c] else line
                    if c == own[0]:
                        break
                for _ in own[1:]:
                    next(todo)
                text = cell.lines[i] if i < len(cell.lines) else ""
                size = start[own[-1]] + width[own[-1]] - start[own[0]]
                line += text.rjust(size) if cell.right else text.ljust(size)
            out.append(line.rstrip())
    return out


def _walk(node: Node, out: Lines, visible: bool, pre: bool, depth: int, sheet: Sheet, widest: int | None) -> Iterator[tuple]:
    """Renders a node's children; yields the first arguments of the walks that it needs first."""
    number = 0
    if node.tag == "ol":
        start = node.attrs.get("start", "1").strip()
        number = int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if visible and not closed and node.tag not in ("table", "tr", "select") and node.tag not in SECTIONS:
                out.text(child, pre)
            continue
        tag = child.tag
        if closed and tag != "summary":
            continue
        shown, seen = _shown(child, visible, sheet)
        if not shown:
            continue
        if tag == "br":
            out.end(True)
        elif tag == "hr":
            out.add(["---"] if seen else [], True)
        elif tag == "li":
            own = Lines()
            yield child, own, seen, pre, depth + 1
            lines = own.done()
            value = child.attrs.get("value", "").strip()
            number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number + 1
            mark = f"{number}. " if node.tag == "ol" else "- "
            if lines:
                out.add([mark + lines[0], *(" " * len(mark) + x if x else "" for x in lines[1:])], False)
        elif tag in ("blockquote", "dd"):
            own = Lines()
            yield child, own, seen, pre, depth + 1
            out.add(["  " + x if x else "" for x in own.done()], tag == "blockquote")
        elif tag == "table":
            rows, captions, parts = [], [], []
            todo = [(child, seen)]
            while todo:
                part, part_seen = todo.pop(0)
                # Cells don't span from one section of a table to the next.
                if part.tag in SECTIONS or rows:
                    parts.append(rows)
                    rows = []
                for x in part.children:
                    if isinstance(x, str):
                        if x.strip() and part_seen:
                            captions.append([_SPACE.sub(" ", x).strip()])
                        continue
                    ok, x_seen = _shown(x, part_seen, sheet)
                    if not ok or x.tag in ("col", "colgroup"):
                        continue
                    if x.tag in SECTIONS:
                        todo.append((x, x_seen))
                    elif x.tag == "tr":
                        row = []
                        for cell in x.children:
                            if isinstance(cell, str):
                                if cell.strip() and x_seen:
                                    captions.append([_SPACE.sub(" ", cell).strip()])
                                continue
                            ok, cell_seen = _shown(cell, x_seen, sheet)
                            if not ok:
                                continue
                            own = Lines()
                            if cell.tag in ("td", "th"):
                                yield cell, own, cell_seen, pre, depth + 1
                                right = cell.attrs.get("align", "").lower() == "right" or "text-align:right" in _style(cell)
                                row.append(Cell(own.done(), max(1, _number(cell, "colspan", SPAN)), _number(cell, "rowspan", ROWSPAN), right))
                            else:
                                holder = Node("div", {})
                                holder.children = [cell]
                                yield holder, own, x_seen, pre, depth + 1
                                captions.append(own.done())
                        rows.append(row)
                    else:
                        own = Lines()
                        holder = Node("div", {})
                        holder.children = [x]
                        yield holder, own, part_seen, pre, depth + 1
                        captions.append(own.done())
            parts.append(rows)
            for some in parts:
                for at, row in enumerate(some):
                    for cell in row:
                        cell.rows = min(cell.rows or len(some), len(some) - at)
            out.add([line for c in captions for line in c] + _table([row for some in parts for row in some], widest), True)
        else:
            block = tag in BLOCK
            spaced = tag in SPACED and not (tag in LISTS | {"dl"} and depth > 0)
            if block:
                out.block(spaced)
            yield child, out, seen, pre or tag in ("pre", "xmp", "textarea"), depth
            if block:
                out.block(spaced)


def render(root: Node, widest: int | None = None) -> str:
    """The visible text of a tree."""
    out, sheet = Lines(), style_sheet(root)
    shown, seen = _shown(root, True, sheet)
    stack = [_walk(root, out, seen, False, 0, sheet, widest)] if shown else []
    while stack:
        need = next(stack[-1], None)
        if need is None:
            stack.pop()
        else:
            stack.append(_walk(*need, sheet, widest))
    return "\n".join(out.done())


def extract(page: str | None, widest: int | None = None) -> str:
    return render(parse(page), widest) if page else ""


def extracted(spark: SparkSession, pages: DataFrame, widest: int | None = None) -> DataFrame:
    """page_id, text, n_chars and n_lines of every row of pages."""
    bounded_batches(spark)

    @F.arrow_udf("string")
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in values:
            yield pa.array([extract(v, widest) for v in batch.to_pylist()], pa.string())

    pages = pages.select("page_id", "html")
    found = pages.select("page_id", run.asNondeterministic()(pages["html"]).alias("text"))
    lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long")
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), lines.alias("n_lines"))
