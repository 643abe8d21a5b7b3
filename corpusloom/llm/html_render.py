"""Layout-aware rendering of HTML to text: a tree builder with implied tags, visibility rules, block layout.

The builder accepts any text: unclosed and misnested tags are repaired by the usual rules (paragraphs end
at block starts, items at items, cells at cells, rows are implied in tables, stray end tags are ignored).
Rendering walks the tree with a stack of its own, so nesting depth is bounded by memory only.

Visible: all text that a browser with scripts would show. Hidden: head, script, style, template, noscript,
media fallbacks, data lists, elements with `hidden`, display:none or visibility:hidden, closed dialogs,
what a closed `details` holds besides its summary, options that are not shown. Blocks stand on lines of
their own, paragraphs, headings, lists, quotes, tables and preformatted text between blank lines; list items
carry bullets or numbers and indent their content; the cells of a table are padded to columns, spans
included, as far as the padding stays in proportion to the text; white space collapses outside preformatted text.

Defined results: a null or empty page renders as the empty text; repeated rows each give a row; further columns
stay, those with the name of an output under another one; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the HTML standard: element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
TEXT_ONLY = frozenset("title textarea".split())
HIDDEN = frozenset(
    "head title script style template noscript iframe noembed noframes audio video canvas object datalist "
    "map area base link meta param source track embed rp".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table ul listing xmp caption thead tbody tfoot tr td th select textarea".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl dir menu blockquote pre listing xmp figure table hr fieldset".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul listing xmp".split()
)
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
LISTS = frozenset("ul ol dir menu".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
# A start tag of the first kind ends an open element of the second, up to an element of the third.
CLOSES = {
    "li": (frozenset(["li"]), LISTS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])), "td": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["table", "tr"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])), "tbody": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])), "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])), "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "button": (frozenset(["button"]), frozenset(["table", "td", "th"])), "a": (frozenset(["a"]), frozenset(["table", "td", "th"])),
}
#: Elements that an end tag does not reach beyond.
FENCE = frozenset(["table", "td", "th", "caption", "button", "object", "html"])

TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|/[^a-zA-Z][^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\f\r]+")
#: Open elements that are looked through one by one.
NEAR = 24
#: Widths up to which cells widen their column, the first that fits: all lines of a table are together at most
#: PAD_TIMES its text and PAD_CHARS long. With 0 the cells of a row are two blanks apart and not aligned.
ALIGN = (1 << 30, 400, 120, 40, 16, 0)
PAD_TIMES, PAD_CHARS = 4, 4000


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        """An attribute's value, "" where it has none, None where it is absent."""
        if name not in self.attributes.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None

    def number(self, name: str, default: int, most: int) -> int:
        found = re.match(r"\s*[+-]?\d{1,9}", self.get(name) or "")
        return min(most, int(found[0])) if found else default


class Builder:
    """Grows the tree tag by tag."""

    def __init__(self):
        self.root = Node("html")
        self.stack = [self.root]
        self.in_head = False
        self.has_body = False
        self.open: dict[str, list[int]] = {"html": [0]}  # by tag, the places of its open elements on the stack

    def _push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.open.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def _cut(self, size: int) -> None:
        while len(self.stack) > size:
            tag = self.stack.pop().tag
            self.open[tag].pop()
            if tag == "head":
                self.in_head = False

    def _nearest(self, tags: frozenset) -> int:
        """The place of the nearest open element of tags, 0 without one. Near ones are looked for on the stack; a
        deep nesting is not walked through, its places are known by tag."""
        top = len(self.stack) - 1
        for k in range(top, max(0, top - NEAR), -1):
            if self.stack[k].tag in tags:
                return k
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0) if top > NEAR else 0

    def _close(self, tags: frozenset, fence: frozenset) -> bool:
        """Ends the nearest open element of tags above the nearest of fence."""
        if not any(self.open.get(t) for t in tags):
            return False
        at = self._nearest(tags)
        if not at or self._nearest(fence) > at:
            return False
        self._cut(at)
        return True

    def _body(self) -> None:
        if self.in_head:
            self._close(frozenset(["head"]), frozenset())
        if not self.has_body and len(self.stack) == 1:
            self.has_body = True
            self._push(Node("body"))

    def text(self, data: str) -> None:
        if not data:
            return
        if self.in_head or len(self.stack) == 1:
            if not data.strip(" \t\n\f\r"):
                return
            self._body()
        self.stack[-1].children.append(data)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "html":
            return
        if tag == "head":
            if not self.has_body and not self.open.get("head"):
                self._push(Node("head"))
                self.in_head = True
            return
        if tag == "body":
            self._body()
            return
        if not (tag in HEAD_ONLY and (self.in_head or not self.has_body)):
            self._body()
        if tag in ENDS_PARAGRAPH and self.open.get("p"):
            self._close(frozenset(["p"]), FENCE)
        rule = CLOSES.get(tag)
        if rule:
            # Inner cells, rows and items end with the outer one they stand in.
            if tag == "tr" or tag in SECTIONS:
                while self._close(CELLS, frozenset(["table"])):
                    pass
            if tag in SECTIONS:
                self._close(frozenset(["tr"]), frozenset(["table"]))
            self._close(*rule)
        if self.open.get("table"):
            top = self.stack[-1].tag
            if tag == "tr" and top == "table":
                self._push(Node("tbody"))
            elif tag in CELLS:
                if top == "table":
                    self._push(Node("tbody"))
                    top = "tbody"
                if top in SECTIONS:
                    self._push(Node("tr"))
        node = Node(tag, attributes)
        if tag in VOID:
            self.stack[-1].children.append(node)
        else:
            self._push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p" and not self.open.get("p"):
            self._body()
            self.stack[-1].children.append(Node("p"))
        elif tag == "head":
            self._close(frozenset(["head"]), frozenset())
        elif tag not in ("html", "body") and self.open.get(tag):
            # The end of an inline element does not end the blocks that began inside it; a cell outside a table holds no end back.
            fence = FENCE - {tag} if self.open.get("table") else FENCE - CELLS - {tag}
            self._close(frozenset([tag]), BLOCK if tag not in BLOCK else frozenset() if tag == "table" else fence)


def parse(page: str) -> Node:
    """The tree of a page."""
    page = page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�")
    builder, at, size = Builder(), 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            builder.text(html.unescape(page[at:]))
            break
        found = TAG.match(page, lt)
        if not found:  # a bare < is text
            nxt = page.find("<", lt + 1)
            nxt = size if nxt < 0 else nxt
            builder.text(html.unescape(page[at:nxt]))
            at = nxt
            continue
        if lt > at:
            data = page[at:lt]
            builder.text(html.unescape(data) if "&" in data else data)
        at = found.end()
        if found[2]:
            tag = found[2].lower()
            if tag == "plaintext":
                builder.start("pre", "")
                builder.text(page[at:])
                break
            builder.start(tag, found[3] or "")
            if tag in RAW or tag in TEXT_ONLY:
                closing = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                stop = closing.start() if closing else size
                data = page[at:stop]
                builder.stack[-1].children.append(html.unescape(data) if tag in TEXT_ONLY else data)
                builder._cut(len(builder.stack) - 1)
                close = page.find(">", stop)
                at = size if not closing or close < 0 else close + 1
            elif tag in ("pre", "listing") and page.startswith("\n", at):
                at += 1
        elif found[1]:
            builder.end(found[1].lower())
    return builder.root


def hidden(node: Node) -> bool:
    """Whether an element and all below it are not shown."""
    if node.tag in HIDDEN:
        return True
    if not node.attributes:
        return node.tag == "dialog"
    if node.get("hidden") is not None or (node.tag == "input" and (node.get("type") or "").lower() == "hidden"):
        return True
    if node.tag == "dialog" and node.get("open") is None:
        return True
    style = node.get("style")
    return bool(style and NOT_SHOWN.search(style))


class Flow:
    """The content of a block while it is laid out: finished lines, and the line being filled."""

    __slots__ = ("gap", "line", "lines", "marks", "node", "pre", "rows")

    def __init__(self, node: Node, pre: bool):
        self.node, self.pre = node, pre
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.marks = 0
        self.rows: list[list] | None = None

    def end_line(self, force: bool = False) -> None:
        if not self.line and not force:
            return
        data = "".join(self.line)
        self.line = []
        if self.pre:
            self._add(data.split("\n"))
        else:
            data = SPACE.sub(" ", data).strip(" ")
            if data or force:
                self._add([data])

    def _add(self, lines: list[str]) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.extend(lines)

    def block(self, lines: list[str], spaced: bool) -> None:
        """Place a finished block; blank lines on its two sides join with its neighbours'."""
        self.end_line()
        if not lines:
            return
        if spaced:
            self.gap = 1
        if self.lines or self.gap == 0:
            self._add(lines)
        else:
            self.gap = 0
            self.lines = lines
        self.gap = int(spaced)


Cells = dict[int, tuple[list[str], int]]


def place_cells(rows: list[list[tuple[list[str], int, int]]]) -> list[Cells]:
    """For each row its cells (lines, columns spanned) by their first column, around cells that reach down from above."""
    grid: list[Cells] = []
    taken: dict[int, int] = {}
    for row in rows:
        placed: Cells = {}
        at = 0
        below = {c: n - 1 for c, n in taken.items() if n > 1}
        for lines, wide, high in row:
            while at in taken:
                at += 1
            placed[at] = (lines, wide)
            if high > 1:
                below.update((c, high - 1) for c in range(at, at + wide))
            at += wide
        taken = below
        grid.append(placed)
    return grid


def column_starts(grid: list[Cells], most: int) -> dict[int, int]:
    """Where each column that a cell begins in starts, columns being as wide as their widest cell of up to `most`."""
    width: dict[int, int] = {}
    size = lambda lines: max((n for n in map(len, lines) if n <= most), default=0)
    for row in grid:
        for c, (lines, wide) in row.items():
            if wide == 1:
                width[c] = max(width.get(c, 0), size(lines))
    used = sorted({c for row in grid for c in row})
    needs: dict[tuple[int, int], int] = {}
    for row in grid:
        for c, (lines, wide) in row.items():
            if wide > 1:
                needs[c, wide] = max(needs.get((c, wide), 0), size(lines))
    for (c, wide), need in sorted(needs.items()):
        inside = used[bisect_left(used, c) : bisect_left(used, c + wide)]
        spare = need - sum(width.get(k, 0) for k in inside) - 2 * (len(inside) - 1)
        if spare > 0:
            width[inside[-1]] = width.get(inside[-1], 0) + spare
    starts, total = {}, 0
    for c in used:
        starts[c] = total
        total += width.get(c, 0) + 2
    return starts


def _row_lines(row: Cells, starts: dict[int, int], aligned: bool) -> Iterator[list[tuple[int, str]]]:
    """For each line of a row its cells' texts with the blanks ahead of them."""
    cells = [(c, row[c][0]) for c in sorted(row)]
    for k in range(max((len(lines) for _, lines in cells), default=0)):
        out, end = [], 0
        for c, lines in cells:
            if k < len(lines) and lines[k]:
                gap = max(starts[c] - end if aligned else 0, 2 if end else 0)
                out.append((gap, lines[k]))
                end += gap + len(lines[k])
        yield out


def table_lines(rows: list[list[tuple[list[str], int, int]]], caption: list[str]) -> list[str]:
    """Rows of (lines, columns spanned, rows spanned) as lines with padded columns, two blanks apart. All text is
    shown; cells too wide to widen their column push what follows them in their own line."""
    grid = place_cells(rows)
    text = sum(len(x) for row in grid for lines, _ in row.values() for x in lines)
    for most in ALIGN:
        starts = column_starts(grid, most) if most else {}
        length = sum(gap + len(x) for row in grid for line in _row_lines(row, starts, most > 0) for gap, x in line)
        if not most or length <= PAD_TIMES * text + PAD_CHARS:
            break
    return caption + ["".join(" " * gap + x for gap, x in line) for row in grid for line in _row_lines(row, starts, most > 0)]


def render(page: str | None) -> str:
    """The visible text of a page."""
    return render_counted(page)[0]


def render_counted(page: str | None) -> tuple[str, int, int]:
    """(visible text, tables, list items) of a page."""
    if not isinstance(page, str) or not page:
        return "", 0, 0
    tables = items = 0
    root = parse(page)
    flows = [Flow(root, False)]
    # Entries: (node, entering). An inline element writes into the flow of the block it stands in.
    stack: list = [(root, True)]
    captions: dict[int, list[str]] = {}
    holders: list[Flow] = []  # the open rows and tables
    items_open = tables_open = 0
    while stack:
        node, entering = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            flow.line.append(node)
            continue
        tag = node.tag
        if entering:
            if node is not root:
                if hidden(node):
                    continue
                if tag == "br":
                    if flow.pre:
                        flow.line.append("\n")
                    else:
                        flow.end_line(True)
                    continue
                if tag == "hr":
                    flow.block(["-" * 8], True)
                    continue
                if tag == "input":
                    if (node.get("type") or "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                        flow.line.append(" " + (node.get("value") or "") + " ")
                    continue
                if tag in VOID:
                    continue
                if tag == "q":
                    flow.line.append("“")
                if tag in BLOCK:
                    flow.end_line()
                    flow = Flow(node, flow.pre or tag in ("pre", "listing", "xmp", "textarea"))
                    if tag == "table":
                        flow.rows = []
                        tables += 1
                    if tag in LISTS and tag == "ol":
                        flow.marks = node.number("start", 1, 10**9) - 1
                    if tag in ("tr", "table"):
                        holders.append(flow)
                        tables_open += tag == "table"
                    items_open += tag == "li"
                    flows.append(flow)
            stack.append((node, False))
            children = node.children
            if tag == "details" and node.get("open") is None:
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
            elif tag == "select":
                options = [c for c in _options(node) if not hidden(c)]
                children = options if node.get("multiple") is not None else ([c for c in options if c.get("selected") is not None] or options)[:1]
            stack.extend((c, True) for c in reversed(children))
            continue
        if tag == "q":
            flow.line.append("”")
        if tag not in BLOCK or node is root:
            continue
        flow.end_line()
        flows.pop()
        items_open -= tag == "li"
        if tag in ("tr", "table"):
            holders.pop()
            tables_open -= tag == "table"
        lines, outer = flow.lines, flows[-1]
        if flow.pre and tag in ("pre", "listing", "xmp"):
            while lines and not lines[-1].strip():
                lines.pop()
        if tag in CELLS:
            row = holders[-1] if holders else None
            if row is not None and row.node.tag == "tr":
                row.rows = row.rows or []
                row.rows.append((lines, max(1, node.number("colspan", 1, 1000)), max(1, node.number("rowspan", 1, 65534))))
                continue
        elif tag == "tr":
            table = next((f for f in reversed(holders) if f.node.tag == "table"), None) if tables_open else None
            if table is not None:
                if lines:  # text between cells is shown ahead of them
                    table.rows.append([(lines, 1, 1)])
                table.rows.append(flow.rows or [])
                continue
            lines = lines + (table_lines([flow.rows], []) if flow.rows else [])  # a row outside a table stands for itself
        elif tag == "caption":
            table = next((f for f in reversed(holders) if f.node.tag == "table"), None) if tables_open else None
            if table is not None:
                captions[id(table)] = lines
                continue
        elif tag == "table":
            lines = lines + table_lines([r for r in flow.rows if r], captions.pop(id(flow), []))
        elif tag == "li":
            items += 1
            numbered = outer.node.tag == "ol"
            outer.marks = node.number("value", outer.marks + 1, 10**9) if numbered else outer.marks + 1
            mark = f"{outer.marks}. " if numbered else "- "
            lines = [(mark if k == 0 else " " * len(mark)) + x if x else x for k, x in enumerate(lines or [""])]
        elif tag == "dd" or tag == "blockquote":
            lines = ["    " + x if x else x for x in lines]
        spaced = tag in SPACED and not (tag in LISTS and items_open)
        outer.block(lines, spaced)
    top = flows[0]
    top.end_line()
    text = "\n".join(x.rstrip() for x in top.lines).replace("\xa0", " ").strip("\n")
    return text, tables, items


def _options(node: Node) -> list[Node]:
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            continue
        if x.tag == "option":
            out.append(x)
        else:
            todo.extend(reversed(x.children))
    return out


OUTPUTS = {"text": "string", "n_chars": "long", "n_lines": "long", "n_tables": "long", "n_items": "long"}


def render_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the column, with text, n_chars, n_lines, n_tables and n_items appended. A column of pages with
    one of these names stays too, under the name with `_in` behind it, as often as it takes to be a new one."""
    kept = [c for c in pages.columns if c != column]
    names = [c for c in kept if c not in OUTPUTS]
    renames = {}
    for c in kept:
        if c in OUTPUTS:
            renames[c] = c + "_in"
            while renames[c] in names:
                renames[c] += "_in"
            names.append(renames[c])
    names = [renames.get(c, c) for c in kept]
    renamed = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], F.col(f"`{column}`").alias("html_"))
    schema = T.StructType([*renamed.schema.fields[:-1], *[T.StructField(n, T.StringType() if t == "string" else T.LongType()) for n, t in OUTPUTS.items()]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [render_counted(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            texts, tables, items = zip(*found) if found else ((), (), ())
            arrays = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            arrays += [pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64()), pa.array(tables, pa.int64()), pa.array(items, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *OUTPUTS])

    return renamed.mapInArrow(run, schema)
