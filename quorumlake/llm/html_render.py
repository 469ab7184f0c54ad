"""Layout-aware HTML rendering: a tree with implied tags, visibility rules, and text laid out in blocks, lists and tables."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import small_batches, tidied, unused

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLANKS = re.compile(r"[ \t\n\r\f]+")

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("textarea title".split())
HIDDEN = frozenset("head script style template noembed noframes iframe title datalist audio video canvas object rp noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset".split())
HEAD_ONLY = frozenset("base link meta script style title noscript template".split())
# An opening tag on the left closes the nearest open element on the right, unless one of the third kind is between.
_CELL, _ROW, _PART = frozenset(("td", "th")), frozenset(("tr",)), frozenset(("thead", "tbody", "tfoot"))
IMPLIED_END = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "td": (_CELL, frozenset(("table", "tr"))),
    "th": (_CELL, frozenset(("table", "tr"))),
    "tr": (_ROW, frozenset(("table",))),
    "thead": (_PART, frozenset(("table",))),
    "tbody": (_PART, frozenset(("table",))),
    "tfoot": (_PART, frozenset(("table",))),
}
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend".split())
P_SCOPE = frozenset("table td th caption button object".split())
#: Tags that make up a table, and the open elements that take only those: anything else goes before the table.
STRUCTURE = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
PARTS = frozenset("table colgroup thead tbody tfoot tr".split())
_TABLE, _TEMPLATE, _SELECT, _COLGROUP = (frozenset((t,)) for t in ("table", "template", "select", "colgroup"))
END_SCOPE = frozenset("td th table caption".split())
#: Foreign elements: where HTML begins again inside, what is not drawn, and the HTML tags that end them.
FOREIGN = frozenset(("svg", "math"))
INTEGRATION = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml mphantom".split())
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Blanks that a line is indented by, at most.
INDENT = 800


class Node:
    """mark: the attributes of a select, optgroup or option; of a table under rendering, its lines."""

    __slots__ = ("children", "hidden", "mark", "tag")

    def __init__(self, tag: str, hidden: bool = False):
        self.tag, self.hidden, self.children, self.mark = tag, hidden, [], None


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _invisible(tag: str, raw: str) -> bool:
    if tag in HIDDEN:
        return True
    if not raw or raw == "/":
        return False
    low = raw.lower()
    if "hidden" not in low and "none" not in low:
        return False
    found = _attributes(raw)
    if "hidden" in found or (tag == "input" and found.get("type", "").lower() == "hidden"):
        return True
    style = re.sub(r"\s+", "", found.get("style", "").lower())
    return "display:none" in style or "visibility:hidden" in style


def _show_options(select: Node) -> None:
    """Leaves what a select shows: all options of a list box, the chosen one of a drop-down."""
    found, work = [], list(reversed(select.children))
    size = select.mark.get("size", "")
    box = "multiple" in select.mark or (size.isdecimal() and int(size) > 1)
    while work:
        node = work.pop()
        if isinstance(node, str) or (node.hidden and box):
            continue
        if node.tag == "option":
            if node.mark.get("label"):
                node.children = [node.mark["label"]]
            found.append(node)
            continue
        if node.tag == "optgroup" and box and node.mark.get("label"):
            label = Node("optgroup")
            label.children.append(node.mark["label"])
            found.append(label)
        work += reversed(node.children)
    if not box:
        chosen = [n for n in found if "selected" in n.mark][-1:] or [n for n in found if "disabled" not in n.mark][:1]
        found = [" ", *(c for n in chosen for c in n.children), " "]
    select.children = found


def parse(html: str) -> Node:
    """The element tree. Missing end tags are implied, stray ones ignored, anything left open ends with the text.

    What stands in a table but in no cell or caption goes before the table, as in browsers.
    """
    root = Node("html")
    stack, at, end = [root], 0, len(html)
    opened: dict[str, list[int]] = {}  # the places in the stack of the open elements of each tag
    selects: list[Node] = []

    def push(node: Node) -> None:
        opened.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def close(upto: int) -> None:
        for node in stack[upto:]:
            opened[node.tag].pop()
        del stack[upto:]

    def last(tags: frozenset) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close_implied(tags: frozenset, barrier: frozenset) -> None:
        i = last(tags)
        if i > last(barrier | _TEMPLATE):
            close(i)

    def in_part() -> bool:
        return stack[-1].tag in PARTS and last(_TABLE) > last(_TEMPLATE)

    def insert(item: Node | str) -> None:
        if stack[-1].tag == "colgroup":
            close(len(stack) - 1)
        if in_part():
            before = stack[last(_TABLE) - 1].children  # the table is the last of these
            before.insert(len(before) - 1, item)
        else:
            stack[-1].children.append(item)

    while at < end:
        lt = html.find("<", at)
        match = _TOKEN.match(html, lt) if lt >= 0 else None
        while lt >= 0 and match is None:
            lt = html.find("<", lt + 1)
            match = _TOKEN.match(html, lt) if lt >= 0 else None
        text = html[at : lt if match else end]
        if text:
            blank = text.isspace()
            if stack[-1].tag == "head" and not blank:
                close(len(stack) - 1)
            if not (blank and in_part()):
                insert(unescape(text) if "&" in text else text)
        if match is None:
            break
        at = match.end()
        closing, name, raw = match.groups()
        if name is None:
            continue
        tag = name.lower()
        if closing:
            if tag == "br":
                insert(Node("br"))
            i = last(frozenset((tag,)))
            if tag in ("table", "template", "body", "html"):
                scope = 0
            else:
                scope = last(_TABLE if tag in STRUCTURE else END_SCOPE)
            if i > max(scope, last(_TEMPLATE) if tag != "template" else 0):
                close(i)
                if tag == "svg" and not in_part():
                    insert(" ")
            continue
        if tag == "html":
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            close(len(stack) - 1)
        inner = last(INTEGRATION)
        foreign = last(FOREIGN) > inner
        if foreign and (tag in ENDS_FOREIGN or tag in STRUCTURE):
            close(min(i for t in FOREIGN for i in opened.get(t, ()) if i > inner))
            foreign = False
        node = Node(tag, _invisible(tag, raw) or (foreign and tag in UNDRAWN))
        if (foreign or tag in FOREIGN) and raw.endswith("/"):
            insert(node)
            continue
        table = last(_TABLE)
        if tag in STRUCTURE and table > last(_TEMPLATE):
            row, part = last(_ROW), max(table, last(_PART))
            if tag in _CELL:
                close((row if row > table else part) + 1)
                if row < table:
                    implied = Node("tr")
                    stack[-1].children.append(implied)
                    push(implied)
            elif tag in _ROW:
                close(part + 1)
            else:
                close((max(table, last(_COLGROUP)) if tag == "col" else table) + 1)
            stack[-1].children.append(node)
            if tag not in VOID:
                push(node)
            continue
        if tag == "table" and table > last(_CELL | _TEMPLATE | frozenset(("caption",))):
            close(table)
        if tag in ("input", "textarea", "select") and last(_SELECT) > last(END_SCOPE | _TEMPLATE):
            close(last(_SELECT))
            if tag == "select":
                continue
        if tag in ENDS_P:
            close_implied(frozenset(("p",)), P_SCOPE)
        if tag in IMPLIED_END:
            if tag in ("tr", "thead", "tbody", "tfoot"):
                close_implied(_CELL, _TABLE)
            if tag in _PART:
                close_implied(_ROW, _TABLE)
            close_implied(*IMPLIED_END[tag])
            if tag in _CELL and stack[-1].tag in _PART:
                implied = Node("tr")
                stack[-1].children.append(implied)
                push(implied)
        if tag == "form" and in_part():  # an empty element: the table goes on in its place
            stack[-1].children.append(node)
            continue
        if tag == "text" and foreign:
            insert(" ")
        insert(node)
        if tag in VOID:
            continue
        if tag in RAW or tag in ESCAPABLE:
            stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.IGNORECASE).search(html, at)
            inner = html[at : stop.start() if stop else end]
            node.children.append(unescape(inner) if tag in ESCAPABLE else inner)
            at = stop.end() if stop else end
            continue
        if tag == "plaintext":
            node.children.append(html[at:])
            break
        if tag in ("select", "optgroup", "option"):
            node.mark = _attributes(raw)
            if tag == "select":
                selects.append(node)
        push(node)
    for select in selects:
        _show_options(select)
    return root


class _Out:
    """Lines under construction: text runs collapse blanks, blocks break lines, margins leave one empty line."""

    def __init__(self):
        self.lines, self.line, self.gap, self.margin, self.indent, self.marker = [], "", False, False, "", ""

    def text(self, raw: str, keep: bool) -> None:
        if keep:
            for i, part in enumerate(raw.replace("\r\n", "\n").split("\n")):
                if i:
                    self.newline()
                if part:
                    self._start()
                    self.line += part
            return
        words = _BLANKS.sub(" ", raw)
        if words.startswith(" "):
            self.gap = True
            words = words[1:]
        if not words:
            return
        self._start()
        self.line += (" " if self.gap and self.line.strip() and not self.line.endswith(" ") else "") + words.rstrip(" ")
        self.gap = words.endswith(" ")

    def _start(self) -> None:
        if not self.line:
            if self.margin and self.lines:
                self.lines.append("")
            self.margin = False
            self.line = self.indent + self.marker
            if self.marker:
                self.indent, self.marker = (self.indent + " " * len(self.marker))[:INDENT], ""
            self.gap = False

    def newline(self) -> None:
        if self.margin and self.lines and not self.line:
            return
        self.lines.append(self.line.rstrip())
        self.line, self.gap = "", False

    def end_line(self) -> None:
        if self.line.strip():
            self.lines.append(self.line.rstrip())
        self.line, self.gap = "", False

    def add_margin(self) -> None:
        self.margin = True

    def result(self) -> str:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def _cells(table: Node) -> list[list[str]]:
    rows, work = [], [table]
    while work:
        node = work.pop()
        if node.tag == "tr":
            cells = [_flat(c) for c in node.children if isinstance(c, Node) and c.tag in _CELL and not c.hidden]
            if cells:
                rows.append(cells)
        else:
            work += [c for c in reversed(node.children) if isinstance(c, Node) and not c.hidden and c.tag in ("thead", "tbody", "tfoot", "tr")]
    return rows


def _flat(cell: Node) -> str:
    return " ".join(_laid_out(cell).split())


def _table_lines(table: Node) -> list[str]:
    rows = _cells(table)
    captions = [_flat(c) for c in table.children if isinstance(c, Node) and c.tag == "caption" and not c.hidden]
    widths = [max(len(r[k]) for r in rows if k < len(r)) for k in range(max(map(len, rows), default=0))]
    lines = ["  ".join(cell.ljust(widths[k]) for k, cell in enumerate(r)).rstrip() for r in rows]
    return [line for line in [*captions, *lines] if line]


def render_tree(root: Node) -> str:
    """The layout of all in root. Inner tables are laid out before those around them, so nesting needs no recursion."""
    tables, work = [], [root]
    while work:
        node = work.pop()
        if node.tag == "table":
            tables.append(node)
        work += [c for c in node.children if isinstance(c, Node) and not c.hidden]
    for table in reversed(tables):
        table.mark = _table_lines(table)
    return _laid_out(root)


def _laid_out(root: Node) -> str:
    out = _Out()
    counters: list[int | None] = []
    # (node, False) to enter, ("leave", state) to leave; text as it is
    work: list = [(c, False) for c in reversed(root.children)]
    keep = 0
    while work:
        item, state = work.pop()
        if isinstance(item, str):
            out.text(item, keep > 0)
            continue
        if state:
            tag, indent, was = state
            if tag in BLOCK:
                out.end_line()
                if tag in SPACED and not (tag in ("ul", "ol") and len(counters) > 1):
                    out.add_margin()
            if tag in ("ul", "ol", "menu", "dir"):
                counters.pop()
            if tag == "pre":
                keep -= 1
            out.indent, out.marker = indent, was
            continue
        node = item
        if node.hidden:
            continue
        tag = node.tag
        if tag == "br":
            out.newline() if out.line or not out.margin else None
            continue
        if tag == "wbr":
            continue
        if tag == "hr":
            out.end_line()
            out.add_margin()
            continue
        before = (tag, out.indent, "")
        if tag in BLOCK:
            out.end_line()
            if tag in SPACED and not (tag in ("ul", "ol") and counters):
                out.add_margin()
        if tag == "table":
            for line in node.mark:
                out.text(line, True)
                out.end_line()
            out.add_margin()
            out.indent, out.marker = before[1], ""
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            counters.append(0 if tag == "ol" else None)
        elif tag == "li":
            if counters and counters[-1] is not None:
                counters[-1] += 1
                out.marker = f"{counters[-1]}. "
            else:
                out.marker = "- "
        elif tag in ("dd", "blockquote"):
            out.indent = (out.indent + "  ")[:INDENT]
        elif tag == "pre":
            keep += 1
            if node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\n")
        work.append((node, before))
        work += [(c, False) for c in reversed(node.children)]
    return out.result()


def render(html: str | None) -> str:
    """All visible text of a page, laid out: blocks on lines of their own, blank lines about paragraphs, headings, lists and
    tables, list markers with indents, table cells aligned in columns."""
    return render_tree(parse(html)) if html else ""


def extract_pages(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages without html_col, with out_col (the rendering) and n_chars of it.

    Null and empty pages give the empty text; so does a page with nothing visible. Broken markup is read as browsers do in
    the main: it never fails. Each page is handled whole, by itself; rows and other columns stay as they are, repeated
    ones too, but columns that have the new names are replaced.
    """
    from pyspark.sql import types as T

    small_batches(pages.sparkSession)
    rest = pages.drop(out_col, "n_chars", html_col)
    schema = T.StructType([*rest.schema.fields, T.StructField(out_col, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                texts = [render(h) for h in piece.column(piece.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*piece.schema.names[:-1], out_col, "n_chars"])

    return pages.select(*rest.columns, F.col(html_col).alias(unused(rest, "_html"))).mapInArrow(tidied(run), schema)
