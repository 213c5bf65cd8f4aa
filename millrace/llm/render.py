"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text renderer.

* Tree: comments, declarations and raw-text elements are tokenised first; start tags close what they imply closed (paragraphs,
  list items, table parts, options), end tags close up to their match, void elements have no content.
* Visibility: content of head, scripts, styles, templates and embedded objects, and elements hidden by attribute or
  by a display rule, is not shown. A visibility rule is inherited, and children may override it. Rules are inline or in the page's
  style sheets (types, classes, identifiers, attributes, descendants and children; rules for other media, for states or of sibling
  selectors do not apply), by importance, place, specificity and order. Formulas and drawings show their text, but not annotations,
  descriptions and definitions.
* Text: white space collapses outside preformatted elements; blocks stand on lines of their own, with an empty line around
  paragraphs, headings, lists, tables and quotations; list items have their bullet or number and are indented by depth;
  table cells are padded to aligned columns, spans included; where that would take a table beyond ``AREA`` characters, cells wrap
  inside the widest columns, as on a screen. No text is left out.

Building and rendering use explicit stacks; elements nested deeper than ``MAX_DEPTH`` are made siblings, as browsers do. Spans are held
as ranges of columns, so they take no memory by their size.

Defined results: null and empty pages give empty text; very long pages are rendered whole. Rows without page_id and repeated rows are
rendered like others. Rules of equal weight: the last counts. Other columns, whatever their names, are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches, table

AREA = 1 << 22
MAX_DEPTH = 512
#: Largest spans of the HTML standard.
MAX_ACROSS, MAX_DOWN = 1000, 65_534

# Element classes of the HTML standard: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
HIDDEN = frozenset(
    "head script style template title meta link base noscript iframe noembed noframes object audio video canvas datalist param source track area annotation annotation-xml mphantom".split()
)
#: Not shown in drawings.
HIDDEN_DRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure menu dir hr fieldset".split())
CLOSES_P = BLOCK - frozenset("body dd dt html legend li option optgroup tbody td tfoot th thead tr caption".split())
IN_HEAD = frozenset("title meta link base script style template noscript".split())
#: A start tag closes these open elements, searched for up to one of the second group.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table".split())),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset("td th caption".split()), frozenset("table tr".split())),
    "th": (frozenset("td th caption".split()), frozenset("table tr".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "rp": (frozenset("rp rt".split()), frozenset(["ruby"])),
    "rt": (frozenset("rp rt".split()), frozenset(["ruby"])),
}
#: An end tag does not reach out of these.
SCOPE = frozenset("table td th caption html template".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>\x00]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>\x00]*+)(?P<attrs2>[^>]*+)>?"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_ATTR = re.compile(r"([^\s/=\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RULE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def tree(source: str, sheets: list[str] | None = None) -> Node:
    """The document's element tree; the text of its style sheets goes to ``sheets``."""
    root = Node("html", {})
    stack, at, n = [root], 0, len(source)

    def close(names: frozenset[str], stop: frozenset[str]) -> None:
        """Closes the outermost open element of ``names`` inside the nearest of ``stop``."""
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                found = k
            elif stack[k].tag in stop:
                break
        if found:
            del stack[found:]

    def close_p() -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                return
            if stack[k].tag in SCOPE or stack[k].tag in BLOCK:
                return

    while at < n:
        m = _TOKEN.match(source, at)
        at = m.end()
        if (text := m["text"]) is not None:
            if stack[-1].tag == "head" and not text.isspace():
                del stack[-1:]
            stack[-1].children.append(text)
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag not in ("html", "body"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if stack[k].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "template"):
                        break
            continue
        attrs = _attributes(m["attrs"] or m["attrs2"] or "")
        if tag in ("html", "body"):
            if tag == "body" and any(x.tag == "head" for x in stack):
                del stack[next(k for k, x in enumerate(stack) if x.tag == "head") :]
            if tag == "body" and not any(x.tag == "body" for x in stack):
                body = Node("body", attrs)
                stack[-1].children.append(body)
                stack.append(body)
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            del stack[-1:]
        if tag in CLOSES_P:
            close_p()
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW or tag in RCDATA:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            body = source[at : end.start() if end else n]
            if tag == "style" and sheets is not None and attrs.get("media", "").strip().lower() in ("", "all", "screen"):
                sheets.append(body)
            at = end.end() if end else n
            node.children.append(body if tag in RCDATA else body.replace("&", "&amp;"))
        elif tag not in VOID and not (m["attrs"] or "").endswith("/") or tag in BLOCK:
            if tag not in VOID and len(stack) < MAX_DEPTH:
                stack.append(node)
    return root


#: A step of a selector: whether the one before is its parent (else any ancestor), type, and (attribute, value) it needs.
Selector = list[tuple[bool, str, list[tuple[str, str | None]]]]
_COMPOUND = re.compile(r"(?:[a-zA-Z*][\w-]*)?(?:[.#][\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\])*")
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]")


def selector(text: str) -> tuple[tuple[int, int, int], Selector] | None:
    """Specificity and steps of a selector; None if it has anything beyond those that are known."""
    steps: Selector = []
    weight, child = [0, 0, 0], False
    for part in re.findall(r"(?:\[[^\]]*\]|[^\s>\[])+|>", text):
        if part == ">":
            child = True
            continue
        if not _COMPOUND.fullmatch(part):
            return None
        name = re.match(r"[a-zA-Z*][\w-]*|", part)[0].lower()
        needs = []
        for mark, value, attr, a, b, c in _PART.findall(part):
            weight[0 if mark == "#" else 1] += 1
            if mark:
                needs.append(("id" if mark == "#" else "class", value))
            else:
                needs.append((f"={attr.lower()}", a or b or c or None))
        weight[2] += name not in ("", "*")
        steps.append((child, "" if name == "*" else name, needs))
        child = False
    return (tuple(weight), steps) if steps else None


class Sheet:
    """Display and visibility rules of style sheets, found by the last step's identifier, class or type."""

    def __init__(self, sheets: list[str]):
        self.by_key: dict[str, list] = {}
        self.n = 0
        for css in sheets:
            self._read(re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", " ", css, flags=re.S))

    def _read(self, css: str) -> None:
        at, applies = 0, []
        while (brace := css.find("{", at)) >= 0:
            before = css[at:brace]
            del applies[max(0, len(applies) - before.count("}")) :]
            head = re.split("[};]", before)[-1].strip()
            if head.startswith("@"):
                words = head.lower().split(None, 1)
                if words[0] in ("@media", "@layer", "@supports"):
                    media = [x.strip() for x in words[1].split(",")] if len(words) > 1 else []
                    applies.append(words[0] != "@media" or "screen" in media or "all" in media)
                    at = brace + 1
                else:
                    at = self._skipped(css, brace)
                continue
            end = css.find("}", brace)
            end = len(css) if end < 0 else end
            found = _RULE.findall(css[brace + 1 : end])
            for text in head.split(",") if found and all(applies) else ():
                if known := selector(text.strip()):
                    self._add(*known, found)
            at = min(end + 1, len(css))

    @staticmethod
    def _skipped(css: str, brace: int) -> int:
        depth = 0
        for m in re.compile("[{}]").finditer(css, brace):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return m.end()
        return len(css)

    def _add(self, weight: tuple, steps: Selector, found: list) -> None:
        _, tag, needs = steps[-1]
        keys = [f"#{v}" for k, v in needs if k == "id"] + [f".{v}" for k, v in needs if k == "class"] + [tag or "*"]
        self.n += 1
        self.by_key.setdefault(keys[0], []).append((weight, self.n, steps, found))

    def of(self, chain: tuple) -> list[tuple]:
        """(importance, weight, order, property, value) of the rules that match the node at the head of a chain of ancestors."""
        node = chain[0]
        keys = ["*", node.tag, *(f".{c}" for c in node.attrs.get("class", "").split())]
        keys += [f"#{node.attrs['id'].strip()}"] if "id" in node.attrs else []
        out = []
        for key in dict.fromkeys(keys):
            for weight, n, steps, found in self.by_key.get(key, ()):
                if _fits(chain, steps):
                    out += [(bool(important), weight, n, k.lower(), v.lower()) for k, v, important in found]
        return out


def _meets(node: Node, tag: str, needs: list[tuple[str, str | None]]) -> bool:
    if tag and node.tag != tag:
        return False
    for name, value in needs:
        if name == "class":
            if value not in node.attrs.get("class", "").split():
                return False
        elif name == "id":
            if node.attrs.get("id", "").strip() != value:
                return False
        elif name[1:] not in node.attrs or value is not None and node.attrs[name[1:]] != value:
            return False
    return True


def _fits(chain: tuple, steps: Selector) -> bool:
    """Whether the node at the head of the chain, with its ancestors, meets the steps: each pair of them is looked at once."""
    if not _meets(chain[0], *steps[-1][1:]):
        return False
    if len(steps) == 1:
        return True
    # Steps that an ancestor's descendant, or its child, has met: those before them are looked for further up.
    any_above, next_above = set(), {len(steps) - 1}
    above = chain[1]
    while above is not None:
        met = set()
        for k in next_above | any_above:
            if _meets(above[0], *steps[k - 1][1:]):
                if k == 1:
                    return True
                met.add(k - 1)
        any_above |= {k for k in next_above if not steps[k][0]}
        next_above = met
        above = above[1]
    return False


def rules(chain: tuple, drawing: bool, sheet: Sheet) -> dict[str, str]:
    """The node's own display and visibility: of a drawing's attributes, the style sheets and the inline style, important ones last."""
    node = chain[0]
    found = [(False, (-1,), 0, k, node.attrs[k].strip().lower()) for k in ("display", "visibility") if drawing and k in node.attrs]
    if sheet.n:
        found += sheet.of(chain)
    for n, (k, v, important) in enumerate(_RULE.findall(node.attrs.get("style", ""))):
        found.append((bool(important), (1 << 30,), n, k.lower(), v.lower()))
    return {k: v for *_, k, v in sorted(found)}


def pruned(node: Node, own: dict[str, str], drawing: bool) -> bool:
    """Whether neither the node nor anything in it is shown."""
    if node.tag in HIDDEN or drawing and node.tag in HIDDEN_DRAWN or "hidden" in node.attrs or own.get("display") == "none":
        return True
    return node.tag == "input" and node.attrs.get("type", "").lower() == "hidden"


def shows(own: dict[str, str], inherited: bool) -> bool:
    value = own.get("visibility", "inherit")
    return value not in ("hidden", "collapse") if value in ("visible", "hidden", "collapse", "initial") else inherited


class Lines:
    """Text as it flows: lines, and how many breaks and blank lines are due before the next word."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.prefix: list[str] = []
        self.mark = ""
        self.blocks = 0

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
            self.blocks += 1
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        if self.lines:
            self.gap = max(self.gap, int(spaced))

    def _open(self) -> None:
        if not self.line:
            self.lines.extend([""] * self.gap)
            self.gap = 0
            indent = "".join(self.prefix)
            self.line.append(indent[: len(indent) - len(self.mark)] + self.mark if self.mark else indent)
            self.mark = ""
            self.space = False

    def text(self, s: str) -> None:
        words = _SPACE.split(s)
        for k, word in enumerate(words):
            if k:
                self.space = bool(self.line)
            if word:
                self._open()
                if self.space:
                    self.line.append(" ")
                self.line.append(word)
                self.space = False

    def keep(self, s: str) -> None:
        for k, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                self._open()
                self.lines.append("".join(self.line).rstrip())
                self.line = []
            if part:
                self._open()
                self.line.append(part)

    def rows(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        self.end_line()
        for line in lines:
            self._open()
            self.line.append(line)
            self.end_line()

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _number(text: str | None, default: int, low: int, high: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return min(high, max(low, int(m[1]))) if m else default


def wrapped(line: str, width: int) -> list[str]:
    """The line in pieces of at most ``width`` characters, cut at spaces where there are some."""
    out = []
    while len(line) > width:
        at = line.rfind(" ", 1, width + 1)
        out.append(line[: at if at > 0 else width].rstrip())
        line = line[at if at > 0 else width :].lstrip(" ")
    return [*out, line] if line or not out else out


def placed(grid: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Rows of (lines, colspan, rowspan) to rows of (column, colspan, lines). Cells that reach down are ranges of columns."""
    out, reach = [], []
    for r, row in enumerate(grid):
        reach = [x for x in reach if x[2] > r]
        col, at, cells, fresh = 0, 0, [], []
        for lines, across, down in row:
            while at < len(reach) and reach[at][0] <= col:
                col = max(col, reach[at][1])
                at += 1
            if down > 1:
                fresh.append((col, col + across, min(r + down, len(grid))))
            cells.append((col, across, lines))
            col += across
        out.append(cells)
        if fresh:
            merged: list[tuple[int, int, int]] = []
            for lo, hi, until in sorted(reach + fresh):
                if merged and merged[-1][1] >= lo and merged[-1][2] == until:
                    merged[-1] = (merged[-1][0], max(hi, merged[-1][1]), until)
                else:
                    merged.append((lo, hi, until))
            reach = merged
    return out


def _widths(cells_of: list, used: list[int]) -> list[int]:
    width, wide = [0] * len(used), []
    for cells in cells_of:
        for c, across, lines in cells:
            if lines:
                first, n = bisect_left(used, c), max(map(len, lines))
                last = bisect_left(used, c + across) - 1
                if first == last:
                    width[first] = max(width[first], n)
                elif cells[-1][0] > c:
                    wide.append((last - first, first, last, n))
    for _, first, last, n in sorted(wide):
        held = sum(width[first : last + 1]) + 2 * (last - first)
        width[last] += max(0, n - held)
    return width


def aligned(grid: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, colspan, rowspan) to text lines with aligned columns."""
    cells_of = placed(grid)
    used = sorted({c for cells in cells_of for c, _, lines in cells if lines})
    width = _widths(cells_of, used)
    most = max(width, default=0)
    while most > 20 and sum(min(w, most) + 2 for w in width) * sum(max((len(x) for _, _, x in cells), default=0) for cells in cells_of) > AREA:
        most //= 2
    if most < max(width, default=0):
        cells_of = [[(c, across, [p for x in lines for p in wrapped(x, max(most, 1))]) for c, across, lines in cells] for cells in cells_of]
        width = _widths(cells_of, used)
    start, at = {}, 0
    for c, w in zip(used, width, strict=True):
        start[c] = at
        at += w + 2
    out = []
    for cells in cells_of:
        cells = [(start[c], lines) for c, _, lines in cells if lines]
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            line: list[str] = []
            length = 0
            for at, lines in cells:
                if k < len(lines) and lines[k]:
                    pad = max(at - length, 2 if length else 0) if length else at
                    line += [" " * pad, lines[k]]
                    length += pad + len(lines[k])
            out.append("".join(line).rstrip())
    return out


def render(source: str | None) -> tuple[str, int, int]:
    """Visible text, its non-empty lines, and the tables laid out."""
    if not source:
        return "", 0, 0
    out, tables, sheets = Lines(), 0, []
    root = tree(source, sheets)
    sheet = Sheet(sheets)
    #: (what, node, shown, in a drawing, chain of ancestors); frames of tables collect rows of cells.
    tasks: list[tuple] = [("node", root, True, False, None)]
    sinks: list[Lines] = [out]
    grids: list[list] = []
    lists: list[list] = []
    pre = 0
    while tasks:
        what, node, shown, drawing, above = tasks.pop()
        sink = sinks[-1]
        if what == "text":
            if shown:
                (sink.keep if pre else sink.text)(html.unescape(node).replace("\xa0", " "))
            continue
        if what == "leave":
            tag = node.tag
            if tag in ("pre", "textarea"):
                pre -= 1
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if tag in ("li", "dd", "blockquote") and sink.prefix:
                sink.end_line()
                sink.prefix.pop()
                sink.mark = ""
            if tag in ("td", "th"):
                lines = sinks.pop().done()
                while lines and not lines[-1]:
                    lines.pop()
                across = _number(node.attrs.get("colspan"), 1, 1, MAX_ACROSS)
                # A rowspan of 0 reaches to the end.
                down = _number(node.attrs.get("rowspan"), 1, 0, MAX_DOWN) or MAX_DOWN
                if grids and grids[-1][0] is not None:
                    if not grids[-1][1]:
                        grids[-1][1].append([])
                    grids[-1][1][-1].append((lines, across, down))
                else:
                    sinks[-1].rows(lines)
                continue
            if tag == "table":
                _, rows = grids.pop()
                lines = aligned(rows)
                if rows and (shown or lines):
                    tables += 1
                    sink.block(True)
                    sink.rows(lines)
            if tag in BLOCK:
                sink.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir", "dl") and lists))
            elif tag == "text" and drawing:
                sink.text(" ")
            continue
        tag = node.tag
        drawing = (drawing or tag == "svg") and tag != "foreignobject"
        chain = (node, above)
        own = rules(chain, drawing, sheet)
        if pruned(node, own, drawing):
            continue
        shown = shows(own, shown)
        if tag == "text" and drawing:
            sink.text(" ")
        if tag == "br":
            if sink.line:
                sink.end_line()
            else:
                sink.gap = max(sink.gap, 1 if sink.lines else 0)
            continue
        if tag == "wbr":
            continue
        if tag == "input":
            if shown and node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and node.attrs.get("value"):
                sink.text(node.attrs["value"])
            continue
        if tag in BLOCK:
            sink.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir", "dl") and lists))
        if tag in ("pre", "textarea"):
            pre += 1
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag, _number(node.attrs.get("start"), 1, -(10**9), 10**9)])
        elif tag == "li":
            kind = lists[-1] if lists else ["ul", 1]
            if kind[0] == "ol":
                kind[1] = _number(node.attrs.get("value"), kind[1], -(10**9), 10**9)
                mark = f"{kind[1]}. "
                kind[1] += 1
            else:
                mark = "- "
            sink.prefix.append(" " * len(mark))
            sink.mark = mark
        elif tag in ("dd", "blockquote"):
            sink.prefix.append("  ")
        elif tag == "table":
            grids.append([node, []])
        elif tag == "tr" and grids:
            grids[-1][1].append([])
        elif tag in ("td", "th"):
            sinks.append(Lines())
        tasks.append(("leave", node, shown, drawing, above))
        tasks.extend(("text" if isinstance(c, str) else "node", c, shown, drawing, chain) for c in reversed(node.children))
    lines = out.done()
    return "\n".join(lines).strip("\n"), sum(1 for x in lines if x.strip()), tables


def rendered(pages: DataFrame) -> DataFrame:
    """``(page_id, text, n_lines, n_tables)`` per row of ``pages(page_id, html)``."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                rows = [render(x.as_py()) for x in part.column(1)]
                text, lines, tables = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(text, pa.string()), pa.array(lines, pa.int64()), pa.array(tables, pa.int64())],
                    names=["page_id", "text", "n_lines", "n_tables"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, text string, n_lines long, n_tables long"
    )


def op6_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "pages"))
