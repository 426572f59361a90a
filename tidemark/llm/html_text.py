"""Visible text of HTML pages: a tree with implied tags, rendered with its layout."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements without rendered text of their own.
UNSEEN = frozenset(
    "head script style template noscript title meta link iframe object audio video canvas datalist noframes rp "
    "defs symbol clippath mask desc metadata".split()
)
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table "
    "caption thead tbody tfoot tr ul".split()
)
# Blocks set off by an empty line.
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
# Inline elements of the tree that stand on lines of their own.
OWN_LINE = frozenset("option optgroup textarea text".split())
# Of an svg image only these show text.
PAINTED = frozenset(("text", "foreignobject"))
# Fields that show their value, or their placeholder while it is empty.
FIELDS = frozenset(("", "text", "search", "email", "url", "tel", "number"))
BUTTONS = frozenset(("submit", "reset", "button"))
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
_CELLS = frozenset(("td", "th"))
_ROWS = frozenset(("thead", "tbody", "tfoot"))
# A start tag ends open elements of these names, up to the named bounds.
_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "td": (frozenset(("td", "th", "caption", "colgroup")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th", "caption", "colgroup")), frozenset(("table", "tr"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "rt": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "rp": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    **{k: (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))) for k in _ROWS},
}
_ENDS_P = BLOCKS - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr"}
_COMMENT_END = re.compile(r"--!?>")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?", re.I)
# Deeper indents are written as this deep; deeper tables as plain blocks.
DEEPEST = 32
DEEPEST_TABLE = 8
# A wider cell does not widen the other rows of its column.
WIDEST = 160

# What a rule says of a property: important, specificity, place in the page, value.
Claim = tuple[bool, int, int, str]


class Node:
    __slots__ = ("tag", "attrs", "children", "ended")

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []
        self.ended = False


class Rules:
    """Display and visibility from a page's style sheets: rules of a tag, class or id, or a tag with one of both.

    Other selectors and rules inside at-rules are passed over, as are rules on html and body (a page that hides
    itself whole shows itself by script).
    """

    def __init__(self, sheets: list[str]) -> None:
        self.claims: dict[tuple[str, str, str], dict[str, Claim]] = {}
        place = 0
        for selectors, body in _rules("\n".join(sheets)):
            found = _DECLARED.findall(body)
            for selector in selectors.split(",") if found else ():
                m = _SELECTOR.fullmatch(selector.strip())
                if m is None or not m.group() or (m[1] or "").lower() in ("html", "body"):
                    continue
                weight = (100 if m[2] == "#" else 10 if m[2] else 0) + bool(m[1])
                key = ((m[1] or "").lower(), m[2] or "", m[3] or "")
                mine = self.claims.setdefault(key, {})
                for prop, value, important in found:
                    place += 1
                    claim = (bool(important), weight, place, value.lower())
                    mine[prop.lower()] = max(mine.get(prop.lower(), claim), claim)

    def of(self, node: Node) -> dict[str, str]:
        """The values that count for an element; its own style attribute goes before all but important rules."""
        style = node.attrs.get("style")
        if not style and not self.claims:
            return {}
        best: dict[str, Claim] = {}
        if self.claims:
            names = [("", "")]
            if node.attrs.get("id"):
                names.append(("#", node.attrs["id"]))
            names += [(".", c) for c in set((node.attrs.get("class") or "").split())]
            for mark, name in names:
                for tag in ("", node.tag):
                    for prop, claim in self.claims.get((tag, mark, name), {}).items():
                        best[prop] = max(best.get(prop, claim), claim)
        for place, (prop, value, important) in enumerate(_DECLARED.findall(style or "")):
            claim = (bool(important), 1_000, place, value.lower())
            best[prop.lower()] = max(best.get(prop.lower(), claim), claim)
        return {prop: claim[3] for prop, claim in best.items()}


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and body of each rule outside of at-rules."""
    css = re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", " ", css, flags=re.S)
    depth, start, head = 0, 0, ""
    for m in re.finditer(r"[{};]", css):
        if m.group() == "{":
            if depth == 0:
                head, start = css[start : m.start()].strip(), m.end()
            depth += 1
        elif m.group() == "}":
            depth = max(0, depth - 1)
            if depth == 0:
                if not head.startswith("@"):
                    yield head, css[start : m.start()].strip()
                head, start = "", m.end()
        elif depth == 0:  # an at-rule without a block
            start = m.end()


class TreeBuilder(HTMLParser):
    """Builds a tree from any tag soup; never fails and never nests by recursion.

    Places of open elements are kept by name, so an end that finds nothing to close scans nothing.
    """

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.body = Node("body", {})
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.sheets: list[Node] = []

    # The page is fed whole: markup that has no end reaches to the end of the page and shows nothing.
    def parse_starttag(self, i: int) -> int:
        k = super().parse_starttag(i)
        return len(self.rawdata) if k < 0 else k

    def parse_endtag(self, i: int) -> int:
        k = super().parse_endtag(i)
        return len(self.rawdata) if k < 0 else k

    def parse_pi(self, i: int) -> int:
        k = super().parse_pi(i)
        return len(self.rawdata) if k < 0 else k

    def parse_html_declaration(self, i: int) -> int:  # a doctype, or a comment of another form
        k = self.rawdata.find(">", i)
        return len(self.rawdata) if k < 0 else k + 1

    def parse_comment(self, i: int, report: bool = True) -> int:
        m = _COMMENT_END.search(self.rawdata, i + 2)
        return len(self.rawdata) if m is None else m.end()

    def _top(self) -> Node:
        return self.stack[-1]

    def _open(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def _cut(self, at: int) -> None:
        """Ends the element at a place of the stack and all inside it."""
        while len(self.stack) > at or self.stack[-1].ended:
            node = self.stack.pop()
            if not node.ended:
                self.places[node.tag].pop()
                if node.tag in BLOCKS:
                    self.blocks.pop()

    def _last(self, names: frozenset[str]) -> int:
        """Place of the innermost open element of these names, or 0."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def _into_body(self) -> None:
        if len(self.stack) == 1 and self.body not in self.root.children[-1:]:
            self.root.children.append(self.body)
        if len(self.stack) == 1:
            self._open(self.body)

    def _close(self, names: frozenset[str], bounds: frozenset[str]) -> None:
        """End the outermost open element of ``names`` above the nearest bound, and all inside it."""
        bound = self._last(bounds - names)
        found = []
        for n in names:
            open_ = self.places.get(n)
            if open_ and open_[-1] > bound:
                found.append(open_[bisect_right(open_, bound)])
        if found:
            self._cut(min(found))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(reversed(attrs))  # the first of repeated attributes counts
        if tag in ("html", "body"):
            node = self.root if tag == "html" else self.body
            node.attrs = given | node.attrs
            if tag == "body":
                self._close(frozenset(("head",)), frozenset())
                self._into_body()
            return
        if tag == "head":
            if len(self.stack) == 1:
                node = Node(tag, given)
                self.root.children.append(node)
                self._open(node)
            return
        if self._top().tag == "head" and tag not in HEAD_ONLY:
            self._cut(len(self.stack) - 1)
        if len(self.stack) == 1 and tag not in HEAD_ONLY:
            self._into_body()
        if tag in _ENDS_P:
            self._close(frozenset(("p",)), frozenset(("button", "td", "th", "caption", "table", "object", "li", "div")))
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self._top().tag):
            self._cut(len(self.stack) - 1)
        if tag in _CELLS and self._top().tag in ("table", *_ROWS):  # a cell without a row
            self._push("tr", {})
        self._push(tag, given)

    def _push(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self._top().children.append(node)
        if tag == "style" and not self.places.get("noscript") and not self.places.get("template"):
            self.sheets.append(node)
        if tag not in VOID:
            self._open(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends void elements only

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        bounds = frozenset(("td", "th", "caption", "table")) if tag not in (*_CELLS, "table", "tr", *_ROWS) else frozenset()
        if tag in (*_CELLS, "tr", *_ROWS):
            bounds = frozenset(("table",))
        at = self._last(frozenset((tag,)))
        if at and at >= self._last(bounds):
            if tag not in BLOCKS and self.blocks and self.blocks[-1] > at:
                self.places[tag].pop()  # an inline element ends alone: the blocks opened in it stay open
                self.stack[at].ended = True
            else:
                self._cut(at)
            return
        if at or self._last(bounds):
            return
        if tag == "p":  # an end tag alone makes an empty paragraph
            self.handle_starttag("p", [])
            self._cut(len(self.stack) - 1)

    def handle_data(self, data: str) -> None:
        top = self._top()
        if top.tag in ("html", "head"):
            if not data.strip():
                return
            if top.tag == "head":
                self._cut(len(self.stack) - 1)
            self._into_body()
            top = self._top()
        if top.tag in ("table", "tr", *_ROWS) and not data.strip():
            return
        top.children.append(data)


    def rules(self) -> Rules:
        screen = [n for n in self.sheets if re.search(r"^\s*$|\ball\b|\bscreen\b", n.attrs.get("media") or "", re.I)]
        return Rules(["".join(c for c in n.children if isinstance(c, str)) for n in screen])


def removed(node: Node, style: dict[str, str]) -> bool:
    """Whether an element takes no place at all; a display value of the page goes before the ``hidden`` attribute."""
    if node.tag in UNSEEN:
        return True
    if "display" in style:
        return style["display"] == "none"
    return "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs)


def field_text(node: Node) -> str:
    """What an input shows: the label of a button, the value or placeholder of a text field."""
    kind = (node.attrs.get("type") or "").strip().lower()
    value = node.attrs.get("value") or ""
    if kind in BUTTONS:
        return value
    return (value or node.attrs.get("placeholder") or "") if kind in FIELDS else ""


def _columns(text: str) -> int:
    """Columns a text takes: wide characters two, joining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Flow:
    """Text laid out so far: lines, an open line, and the empty lines wanted before the next."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = False
        self.indent: list[str] = []
        self.marker = ""

    def put(self, text: str) -> None:
        parts = _SPACE.sub(" ", text)
        if not parts:
            return
        if parts[0] == " " and self.line:
            self.space = True
        body = parts.strip(" ")
        if not body:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = parts[-1] == " "
        self.line.append(body)

    def raw(self, text: str) -> None:
        first, *rest = text.split("\n")
        self.line.append(first)
        for part in rest:
            self.end(True)
            self.line.append(part)

    def end(self, empty: bool = False) -> None:
        """Close the open line; ``empty`` keeps a line without text."""
        if self.line or empty:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            lead = "".join(self.indent[:DEEPEST])
            if self.marker:
                lead = lead[: -len(self.marker)] + self.marker if lead.endswith(" " * len(self.marker)) else lead + self.marker
                self.marker = ""
            self.lines.append((lead + "".join(self.line)).rstrip())
        self.line, self.space = [], False

    def apart(self) -> None:
        self.end()
        self.gap = True

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines)


def _span(node: Node, name: str, most: int = 1_000) -> int:
    value = node.attrs.get(name) or "1"
    return max(1, min(int(value), most)) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def _rows_spanned(node: Node) -> int:
    return 65_534 if node.attrs.get("rowspan") == "0" else _span(node, "rowspan", 65_534)


def grid_rows(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int]]]:
    """Text and column span of every cell, with blank cells where a cell from above reaches down.

    Where the blanks would far outnumber the cells, cells stand in their own row only.
    """
    left = 1_000 + 4 * sum(map(len, rows))
    out = []
    reach: list[tuple[int, int, int]] = []  # first column, columns, rows still to fill
    for row in rows:
        line, at, after = [], 0, []
        cells = iter(row)
        for col, span, more in [*reach, (None, 0, 0)]:
            while col is None or at < col:
                cell = next(cells, None)
                if cell is None:
                    if col is not None:
                        line.append(("", col - at))
                        at = col
                    break
                text, wide, high = cell
                line.append((text, wide))
                if high > 1:
                    after.append((at, wide, high - 1))
                at += wide
            if col is not None:
                if at <= col:
                    line.append(("", span))
                    at = col + span
                if more > 1:
                    after.append((col, span, more - 1))
                left -= 1
                if left < 0:
                    return [[(text, wide) for text, wide, _ in r] for r in rows]
        out.append(line)
        reach = sorted(after)
    return out


def table_text(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Cells in aligned columns, ``|`` between them; a cell of several lines makes its row as high."""
    placed = [r for r in grid_rows(rows) if any(text for text, _ in r)]
    width: dict[int, int] = {}
    for row in placed:
        at = 0
        for text, span in row:
            wide = max(map(_columns, text.split("\n"))) if span == 1 else 0
            width[at] = max(width.get(at, 0), min(wide, WIDEST))
            at += span
    starts = sorted(width)
    upto = [0, *accumulate(width[c] for c in starts)]
    out = []
    for row in placed:
        cells = [c[0].split("\n") for c in row]
        rooms, at = [], 0
        for _, span in row:
            lo, hi = bisect_left(starts, at), bisect_left(starts, at + span)
            rooms.append(upto[hi] - upto[lo] + 3 * (hi - lo - 1))
            at += span
        for n in range(max((len(c) for c in cells), default=0)):
            line = []
            for cell, room in zip(cells, rooms, strict=True):
                part = cell[n] if n < len(cell) else ""
                line.append(part + " " * max(0, room - _columns(part)))
            out.append(" | ".join(line).rstrip())
    return out


def _numbered(node: Node) -> list:
    """Kind of a list, its next number and the step to the one after."""
    start, step = node.attrs.get("start") or "", 1
    first = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else None
    if node.tag == "ol" and "reversed" in node.attrs:
        step = -1
        first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if first is None else first
    return [node.tag, 1 if first is None else first, step]


def render(root: Node, rules: Rules) -> str:
    """The visible text. Nested tables and lists keep their place; nothing recurses."""
    flows = [_Flow()]
    lists: list[list] = []
    tables: list[list[list[tuple[str, int, int]]] | None] = []
    pre = 0
    # Step, item, and whether it is visible and, in an image, painted.
    work: list[tuple[str, Node | str, bool, bool]] = [("in", root, True, True)]
    while work:
        step, item, seen, painted = work.pop()
        flow = flows[-1]
        if isinstance(item, str):
            if seen and painted:
                flow.raw(item) if pre else flow.put(item)
            continue
        tag = item.tag
        if step == "in":
            style = rules.of(item)
            if removed(item, style):
                continue
            if "visibility" in style and style["visibility"] not in ("inherit", "unset"):
                seen = style["visibility"] not in ("hidden", "collapse")
            if tag == "br":
                if seen:
                    flow.end(True)
                continue
            if tag == "hr":
                flow.apart()
                if seen:
                    flow.line.append("---")
                    flow.apart()
                continue
            if tag == "input":
                if seen:
                    flow.put(field_text(item))
                continue
            if tag == "svg":
                painted = False
            elif tag in PAINTED:
                painted = True
            if tag in APART and not (tag in ("ul", "ol") and lists):
                flow.apart()
            elif tag in BLOCKS or tag in OWN_LINE:
                flow.end()
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append(_numbered(item))
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, 1]
                if kind[0] == "ol" and re.fullmatch(r"-?[0-9]{1,9}", item.attrs.get("value") or ""):
                    kind[1] = int(item.attrs["value"])
                marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
                flow.marker = marker if seen else ""
                kind[1] += kind[2]
                flow.indent.append(" " * len(marker))
            elif tag == "dd":
                flow.indent.append("    ")
            elif tag == "blockquote":
                flow.indent.append("> ")
            elif tag in ("pre", "textarea"):
                pre += 1
            elif tag == "optgroup":
                if seen:
                    flow.put(item.attrs.get("label") or "")
            elif tag == "rt":
                if seen:
                    flow.put("(")
            elif tag == "table":
                tables.append([] if len(tables) < DEEPEST_TABLE else None)
            elif tag == "tr" and tables and tables[-1] is not None:
                tables[-1].append([])
            elif tag in _CELLS and tables:
                if tables[-1] is None:
                    flow.end()
                else:
                    if not tables[-1]:
                        tables[-1].append([])
                    flows.append(_Flow())
            work.append(("out", item, seen, painted))
            children = item.children
            if tag == "details" and "open" not in item.attrs:  # closed: only its summary shows
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            work.extend(("in", child, seen, painted) for child in reversed(children))
            continue
        if tag in _CELLS and tables:
            if tables[-1] is None:
                flow.end()
            elif len(flows) > 1:
                tables[-1][-1].append((flows.pop().text(), _span(item, "colspan"), _rows_spanned(item)))
            continue
        if tag == "table":
            for line in table_text(tables.pop() or []):
                flow.line.append(line)
                flow.end(True)
            flow.apart()
            continue
        if tag in APART and not (tag in ("ul", "ol") and len(lists) > 1):
            flow.apart()
        elif tag in BLOCKS or tag in OWN_LINE:
            flow.end()
        if tag in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
        elif tag == "li":
            flow.indent.pop()
            flow.marker = ""
        elif tag in ("dd", "blockquote"):
            flow.indent.pop()
        elif tag in ("pre", "textarea"):
            pre -= 1
        elif tag == "rt" and seen:
            flow.space = False
            flow.put(")")
    return flows[0].text().strip("\n")


def page_text(html: str | None) -> str:
    builder = TreeBuilder()
    builder.feed((html or "").replace("\x00", ""))
    builder.close()
    return render(builder.root, builder.rules())


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars: one row per page, its whole page read.

    All text a reader would see, in order: blocks on lines of their own, an empty line around
    paragraphs and the like, list items with their marks and depth, preformatted text as it is, table
    cells in aligned columns, what fields, buttons and options show, text in svg images, ruby in parentheses.
    Left out are scripts, styles, the head, closed details, and what ``hidden``, an inline style or a plain
    rule of the page's style sheets hides; visibility is inherited, so a visible part of a hidden one stays.
    Indents are written ``DEEPEST`` deep; tables inside ``DEEPEST_TABLE`` others as plain blocks. Null and empty pages give
    an empty text; broken markup never fails.
    """
    bounded_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(h.as_py()) for h in batch.column(1)]
            cols = [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.record_batch(cols, schema=schema)

    return pages.select(F.col(id_col).cast("long"), F.col(html_col)).mapInArrow(
        run, "page_id long, text string, n_chars long"
    )
