"""Layout against a slow renderer that works from the page's structure, not from its tags; style sheets; spans; wide cells."""

import html
import random
import time

import pytest

from millrace.llm import render as R
from millrace.llm.render import render

WORDS = "alpha beta gamma delta épée 日本 x < & > \"quoted\" a_long_word_that_goes_on_and_on_for_a_while".split(" ")


class Page:
    """A random page: its HTML, and the layout its structure asks for, as (lines, spaced) blocks."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def pick(self, *options):
        return self.rng.choice(options)

    def blank(self):
        return self.pick("", " ", "\n", "\t \n ")

    def hidden(self):
        return self.pick("<script>if (a < b) '<p>'</script>", "<!-- <p>no -->", "<span hidden>no</span>", "<i style='color:red;display:none'>no<b>no</b></i>", "<em class='x gone'>no</em>", "<b style='visibility:hidden'>no</b>", "<template><p>no</template>", "")

    def inline(self, breaks=True):
        """HTML and the lines of a run of text."""
        out, lines = [], [[]]
        for _ in range(self.rng.randrange(1, 7)):
            word = self.rng.choice(WORDS)
            tag = self.pick("", "", "b", "span", "a href='x>y'", "code")
            text = html.escape(word, quote=False)
            out.append(f"<{tag}>{text}</{tag.split()[0]}>" if tag else text)
            lines[-1].append(word)
            out.append(self.pick(" ", "\n", "  \t ") + self.hidden())
            if breaks and self.rng.random() < 0.1:
                out.append(self.pick("<br>", "<br/>"))
                lines.append([])
        out.append("end")
        lines[-1].append("end")
        return "".join(out), [" ".join(x) for x in lines]

    def items(self, depth):
        """HTML and lines of a list."""
        kind = self.pick("ul", "ol")
        start = self.rng.randrange(1, 12)
        out, lines = [f"<{kind} start={start}>" if kind == "ol" else "<ul>"], []
        for k in range(self.rng.randrange(1, 4)):
            text, own = self.inline()
            mark = f"{start + k}. " if kind == "ol" else "- "
            inner = own
            out.append(f"{self.blank()}<li>{text}")
            if depth and self.rng.random() < 0.4:
                more, nested = self.items(depth - 1)
                out.append(more)
                inner = own + nested
            out.append(self.pick("", "</li>"))
            lines += [(mark if n == 0 else " " * len(mark)) + x for n, x in enumerate(inner)]
        return "".join(out) + f"</{kind}>", lines

    def table(self):
        n, rows, out, widths = self.rng.randrange(1, 5), [], ["<table>", self.pick("", "<tbody>")], {}
        for _ in range(self.rng.randrange(1, 5)):
            out.append("<tr>")
            row = []
            for c in range(n):
                text, lines = self.inline() if self.rng.random() < 0.85 else ("", [])
                tag = self.pick("td", "th")
                out.append(f"{self.blank()}<{tag}>{self.blank()}{text}" + self.pick("", f"</{tag}>"))
                row.append(lines)
                if lines:
                    widths[c] = max(widths.get(c, 0), *map(len, lines))
            out.append(self.pick("", "</tr>"))
            rows.append(row)
        lines = []
        for row in rows:
            for k in range(max(len(x) for x in row)):
                cells = [(row[c][k] if k < len(row[c]) else "").ljust(widths[c]) for c in range(n) if c in widths]
                lines.append("  ".join(cells).rstrip())
        return "".join(out) + "</table>", [(lines, True)] if lines else []

    def block(self, depth):
        kind = self.pick("p", "p", "h2", "div", "list", "quote", "table", "pre", "hide", "section")
        if kind in ("p", "h2"):
            text, lines = self.inline()
            return f"<{kind}>{text}" + (self.pick("", "</p>") if kind == "p" else "</h2>"), [(lines, True)]
        if kind == "list":
            text, lines = self.items(2)
            return text, [(lines, True)]
        if kind == "table":
            return self.table()
        if kind == "pre":
            lines = [self.pick("  a < b", "x", "if  (y):", "    deep") for _ in range(3)]
            return f"<pre>{html.escape(chr(10).join(lines), quote=False)}</pre>", [(lines, True)]
        if kind == "hide":
            inner, _ = self.block(depth - 1) if depth else ("no", [])
            return self.pick("<div class=gone>", "<div hidden>", "<div style='DISPLAY : none'>") + inner + "</div>", []
        blocks = [self.block(depth - 1) for _ in range(self.rng.randrange(1, 4))] if depth else [(self.inline()[0], None)]
        if not depth:
            text, lines = self.inline()
            return f"<div>{text}</div>", [(lines, False)]
        body, inner = self.blank().join(x[0] for x in blocks), [y for x in blocks for y in x[1]]
        if kind == "quote":
            flat = self.joined(inner)
            return f"<blockquote>{body}</blockquote>", [([f"  {x}" if x else "" for x in flat], True)] if flat else []
        return f"<{kind}>{body}</{kind}>", inner

    @staticmethod
    def joined(blocks):
        out, before = [], False
        for lines, spaced in blocks:
            out += [""] if out and (spaced or before) else []
            out += lines
            before = spaced
        return out

    def whole(self):
        blocks = [self.block(3) for _ in range(self.rng.randrange(1, 7))]
        head = self.pick("", "<!DOCTYPE html><html><head><title>no</title><style>/* c */ .gone { color: red; display: none }</style></head><body>", "<style>em.gone,.gone{display:none}</style>")
        if "gone" not in head:
            head = "<style>.gone{display:none}</style>"
        return head + self.blank().join(x[0] for x in blocks), "\n".join(self.joined([y for x in blocks for y in x[1]])).strip("\n")


@pytest.mark.parametrize("seed", range(400))
def test_layout_equals_a_slow_renderer(seed):
    page, want = Page(seed).whole()
    assert render(page)[0] == want, page


@pytest.mark.parametrize(
    "css, page, text",
    [
        (".a{display:none}", "<p class='b a'>no</p>ok", "ok"),
        ("#i > .a { display : none !important }", "<div id=i><p class=a style='display:block'>no</p><b><i class=a>yes</i></b></div>", "yes"),
        ("nav li{visibility:hidden}", "<nav><ul><li>no<b style='visibility:visible'>yes</b></ul></nav>", "- yes"),
        ("p{display:none} p.keep{display:block}", "<p>no<p class=keep>yes", "yes"),
        ("p.keep{display:block} p{display:none}", "<p>no<p class=keep>yes", "yes"),
        ("@media print{p{display:none}} @media screen{.s{display:none}}", "<p>yes<p class=s>no", "yes"),
        ("@media (max-width:9px){p{display:none}} @font-face{src:x} @keyframes k{from{display:none}} .z{display:none}", "<p>yes<p class=z>no", "yes"),
        ("a:hover,p+p{display:none}", "<p>yes<p>yes <a>yes</a>", "yes\n\nyes yes"),
        ("[data-x='1']{display:none}", "<p data-x=1>no<p data-x=2>yes", "yes"),
        ("p{display:none", "<p>no</p>yes", "yes"),
        ("*{visibility:visible}", "<p style='visibility:hidden'>no</p>yes", "yes"),
    ],
)
def test_style_sheets(css, page, text):
    assert render(f"<style>{css}</style>{page}")[0] == text
    assert render(f"<style media=print>{css}</style>x")[0] == "x"


def test_selectors_equal_a_search_of_all_ancestors():
    rng = random.Random(8)

    def fits(path, steps, k):
        if steps[k][1] and path[-1].tag != steps[k][1]:
            return False
        if not k:
            return True
        starts = [len(path) - 1] if steps[k][0] else range(1, len(path))
        return any(n > 0 and fits(path[:n], steps, k - 1) for n in starts)

    for _ in range(3000):
        path = [R.Node(rng.choice("ab"), {}) for _ in range(rng.randrange(1, 7))]
        steps = [(bool(k) and rng.random() < 0.4, rng.choice(["a", "b", ""]), []) for k in range(rng.randrange(1, 5))]
        chain = None
        for node in path:
            chain = (node, chain)
        assert R._fits(chain, steps) == fits(path, steps, len(steps) - 1)


def test_long_selectors_over_deep_pages_take_no_time():
    start = time.perf_counter()
    css = " ".join(["div"] * 14) + " x{display:none}"
    assert render(f"<style>{css}</style>" + "<div>" * 400 + "<p>" * 300 + "y")[0] == "y" and time.perf_counter() - start < 10


def test_wide_cells_stay_aligned():
    page = "<table>" + "".join(f"<tr><td>{'x' * n}<td>{n}" for n in (70, 500, 3)) + "</table>"
    lines = render(page)[0].split("\n")
    assert [x.index(str(n), 3) for x, n in zip(lines, (70, 500, 3), strict=True)] == [502] * 3


def test_huge_tables_wrap_and_lose_nothing():
    rows = 3000
    page = "<table>" + f"<tr><td>{'word ' * 4000}<td>{'y' * 9000}<td>z" + "".join(f"<tr><td>{k}<td>b<td>c" for k in range(rows)) + "</table>"
    text = render(page)[0]
    assert len(text) < 4 * R.AREA and text.count("word") == 4000 and text.count("y") == 9000
    small = [x for x in text.split("\n") if x.endswith("c")]
    assert len(small) == rows and len({x.index("b") for x in small}) == len({x.index("c") for x in small}) == 1


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><tr><td rowspan=0>r<td>1<tr><td>2<tr><td>3</table>", "r  1\n   2\n   3"),
        ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<tr><td>d<td>e<td>f</table>", "a     b\n      c\nd  e  f"),
        ("<table><tr><td colspan=2>a wide title cell<td>q<tr><td>1<td>2<td>3</table>", "a wide title cell  q\n1  2               3"),
        ("<table><tr><td>1<td rowspan=3>x<td rowspan=2>y<td>2<tr><td>3<td>4<tr><td>5<td>6</table>", "1  x  y  2\n3        4\n5     6"),
    ],
)
def test_spans(page, text):
    assert render(page)[0] == text


def test_spans_take_no_memory_by_their_size():
    start = time.perf_counter()
    page = "<table>" + "<tr><td rowspan=65534 colspan=1000>x" * 2000 + "</table>"
    text = render(page)[0]
    assert text.count("x") == 2000 and time.perf_counter() - start < 20
