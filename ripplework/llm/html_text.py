"""HTML extraction by layout-aware rendering.

A tree builder turns a page into open, close and text events: end tags that may be left out are implied, void and raw
elements are known, stray end tags are ignored. A renderer applies visibility rules (the hidden attribute, style
attributes, and rules of style elements whose selectors name one element by tag, class and id) and writes all visible
text: blocks on lines of their own with blank lines where margins stand, list items with bullets or numbers, table cells
in aligned columns over column and row spans, preformatted text as it is.

A page is read forward once, open elements are found by name and style rules by the name that the fewest rules share, so the
time is linear in the page (only where many rules share all their names with one another does an element meet rules it does not
fit). Layout, never text, is bounded for that by `Layout`: indents stop growing at 32 levels, a column is padded to 80 places
at most, and tables deeper than 16 in one another or wider than 250 columns are written without alignment.

Defined results: null or empty html gives empty text; text without tags is itself, white space collapsed; a tag or comment
that never ends hides what follows, as in a browser; repeated rows, null and equal ids are rendered row by row; an empty
table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import release, slices
from ripplework.session import table

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style template noscript title meta link iframe noembed noframes object canvas audio video datalist".split())
#: Of these an svg or math element draws no text.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern annotation annotation-xml".split())
#: What may stand in a head; any other start tag, or text, ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr form fieldset".split())
BLOCK = MARGIN | frozenset("html body div section article aside nav header footer main address li dt dd tr caption thead tbody tfoot figcaption details summary legend center".split())
CLOSES_P = BLOCK - frozenset("html body li dt dd tr caption thead tbody tfoot summary legend".split())
#: An opening tag ends these open elements, up to the nearest of the others.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "select": ({"select"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
SCOPES = frozenset("table td th".split())
RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
MARKUP = re.compile(r"<(?=[A-Za-z!?]|/[^\s])")
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
#: Up to the tag's end: a quote counts behind an equals sign only. Nothing is ever tried again.
INSIDE = re.compile(r"""(?>[^>=]+|=\s*(?:"[^"]*"|'[^']*'|))*+""")
COMMENT_END = re.compile(r"--!?>")
#: Rules for some media or conditions only are passed over.
RULE = re.compile(r"@[^{};]*+(?:;|\{(?:[^{}]*+\{[^{}]*+\})*+[^{}]*+\}?)?|([^{}@]*+)\{([^{}]*+)\}")
SELECTOR = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+)*)")
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.S)
INTEGER = re.compile(r"\s*(-?\d{1,9})")


def attributes(text: str) -> dict[str, str]:
    """Values by lower-case name; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Layout(NamedTuple):
    """Bounds of the layout, which keep a page's output in proportion to the page; none drops text. `math.inf` lifts one."""

    indent: float = 32
    pad: float = 80
    depth: float = 16
    columns: float = 250


LAYOUT = Layout()
Decls = dict[str, tuple[bool, str]]


def declarations(text: str) -> Decls:
    """(important, value) of display and visibility; of equally important declarations the last counts."""
    out: Decls = {}
    for x in text.split(";"):
        name, _, value = x.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in ("display", "visibility"):
            plain = value.removesuffix("important").rstrip().removesuffix("!").rstrip() if value.endswith("important") else value
            if plain != value or not out.get(name, (False,))[0]:
                out[name] = (plain != value, plain)
    return out


class Styles:
    """Rules of style elements on display and visibility.

    A rule is held by its tag and names, and listed under the name that the fewest rules share. An element looks up either
    all sets of its names that are as large as some rule's, or the rules listed under its names, whichever are fewer.
    """

    def __init__(self, sheets: list[str]):
        self.rules: dict[tuple[str, frozenset[str]], tuple[tuple, Decls]] = {}
        n = 0
        for sheet in sheets:
            for m in RULE.finditer(re.sub(r"/\*(?:[^*]|\*(?!/))*+(?:\*/|$)", " ", sheet)):
                said = declarations(m[2] or "")
                for one in m[1].rsplit(";", 1)[-1].split(",") if said else ():
                    got = SELECTOR.fullmatch(one.strip())
                    if got is None or not one.strip():
                        continue
                    tag, names = (got[1] or "*").lower(), frozenset(re.findall(r"[.#][\w-]+", got[2] or ""))
                    n += 1
                    weight = (sum(x[0] == "#" for x in names), sum(x[0] == "." for x in names), tag != "*", n)
                    before = self.rules.get((tag, names), (weight, {}))[1]
                    self.rules[tag, names] = weight, before | {k: v for k, v in said.items() if v[0] or not before.get(k, v)[0]}
        shared = Counter(x for _, names in self.rules for x in names)
        self.sizes = sorted({len(names) for _, names in self.rules})
        self.by: dict[str, list[frozenset[str]]] = {}
        for names in {names for _, names in self.rules}:
            if names:
                self.by.setdefault(min(names, key=lambda x: (shared[x], x)), []).append(names)

    def sets(self, own: set[str]) -> Iterator[frozenset[str]]:
        """The sets of names that rules might ask for and an element with these has."""
        if sum(math.comb(len(own), k) for k in self.sizes) <= sum(len(self.by.get(x, ())) for x in own):
            for k in self.sizes:
                yield from map(frozenset, combinations(own, k))
        else:
            yield frozenset()
            for x in own:
                yield from (names for names in self.by.get(x, ()) if names <= own)

    def of(self, tag: str, named: dict[str, str]) -> tuple[bool, bool | None]:
        """(not rendered, visible or None where the parent decides) of an element."""
        best: dict[str, tuple] = {"display": ((False, -1), "none")} if "hidden" in named else {}

        def say(said: Decls, weight: tuple) -> None:
            for what, (important, value) in said.items():
                if what not in best or (important, *weight) >= best[what][0]:
                    best[what] = ((important, *weight), value)

        if self.rules:
            own = {"." + c for c in named.get("class", "").split()} | ({"#" + named["id"].strip()} if "id" in named else set())
            for names in self.sets(own):
                for of_tag in (tag, "*"):
                    if (of_tag, names) in self.rules:
                        weight, said = self.rules[of_tag, names]
                        say(said, (0, *weight))
        if "style" in named:
            say(declarations(named["style"]), (1,))
        seen = best.get("visibility", ((), None))[1]
        return best.get("display", ((), ""))[1] == "none", None if seen in (None, "inherit") else seen not in ("hidden", "collapse")


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, "") and ("text", text, ""), properly nested."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # where each name stands on the stack
    at = 0

    def pop() -> tuple[str, str, str]:
        tag = stack.pop()
        places[tag].pop()
        return "close", tag, ""

    def close(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str], nearest: bool = False) -> Iterator[tuple[str, str, str]]:
        """Ends all elements from the outermost (or nearest) of `tags` on that no `stop` stands over."""
        if not any(places.get(t) for t in tags):
            return
        wall = max((places[s][-1] for s in stop if s not in tags and places.get(s)), default=-1)
        ends = [places[t][-1 if nearest else bisect_right(places[t], wall)] for t in tags if places.get(t) and places[t][-1] > wall]
        if ends:
            last = min(ends)
            while len(stack) > last:
                yield pop()

    def text(raw: str) -> Iterator[tuple[str, str, str]]:
        words = html.unescape(raw)
        if stack and stack[-1] == "head" and words.strip(" \t\n\f\r"):
            yield from close({"head"}, frozenset())
        yield "text", words, ""

    while (m := MARKUP.search(page, at)) is not None:
        begin = m.start()
        if begin > at:
            yield from text(page[at:begin])
        named = NAME.match(page, begin)
        if named is None:  # a comment, a declaration or what is read as one
            if page.startswith("<!--", begin):
                end = COMMENT_END.search(page, begin + 2)
                at = end.end() if end else len(page)
            else:
                at = page.find(">", begin) + 1 or len(page)
            continue
        inside = INSIDE.match(page, named.end())
        at = inside.end() + 1
        if at > len(page):  # never ends
            at = len(page)
            break
        tag, attrs = named[1].lower(), inside[0]
        if page[begin + 1] == "/":
            yield from close({tag}, SCOPES - {tag} if tag not in BLOCK or tag in ("li", "p") else frozenset() if tag == "table" else SCOPES - {"td", "th"}, nearest=True)
            if tag == "br":
                yield "open", "br", ""
                yield "close", "br", ""
            continue
        if tag == "head" and any(x != "html" for x in stack):
            continue
        if stack and stack[-1] == "head" and tag not in HEAD:
            yield from close({"head"}, frozenset())
        if tag in CLOSES_P:
            yield from close({"p"}, BLOCK - {"p"})
        if tag in IMPLIED:
            yield from close(*IMPLIED[tag])
        yield "open", tag, attrs
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            yield "close", tag, ""
        elif tag in RAW:
            end = RAW_END[tag].search(page, at)
            stop = end.start() if end else len(page)
            if stop > at:
                yield "text", html.unescape(page[at:stop]) if tag in ("textarea", "title") else page[at:stop], ""
            yield "close", tag, ""
            at = page.find(">", stop) + 1 if end and page.find(">", stop) >= 0 else len(page)
        else:
            places.setdefault(tag, []).append(len(stack))
            stack.append(tag)
    if at < len(page):
        yield from text(page[at:])
    while stack:
        yield pop()


class _Flow:
    """Lines of one block context: the page, or a table cell."""

    def __init__(self):
        self.lines, self.now, self.gap, self.indent = [], [], 0, ""

    def write(self, text: str, pre: bool) -> None:
        if pre:
            for i, x in enumerate(text.split("\n")):
                if i:
                    self.end(1, True)
                self.now.append(x)
            return
        text = re.sub(r"[\s]+", " ", text)
        if not self.now or self.now[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.now.append(text)

    def end(self, gap: int, keep: bool = False) -> None:
        line = "".join(self.now).rstrip()
        if line or keep:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.lines.append(self.indent + line if line else "")
            self.gap = 0
        self.now = []
        self.gap = max(self.gap, gap)

    def text(self) -> str:
        self.end(0)
        return "\n".join(self.lines).strip("\n")


class _Table:
    """Cells by row and first column; columns that a cell of an earlier row spans are left free."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.busy: dict[int, int] = {}  # the last row in which a column is taken from above
        self.span = (1, 1)

    def row(self) -> None:
        self.rows.append([])

    def cell(self, named: dict[str, str]) -> None:
        if not self.rows:
            self.row()

        def number(name: str, most: float) -> int:
            m = INTEGER.match(named.get(name, ""))
            return int(min(max(1, int(m[1])), most)) if m else 1

        self.span = (number("colspan", self.layout.columns), number("rowspan", 65_534))

    def put(self, text: str) -> None:
        row, (wide, high) = self.rows[-1], self.span
        at = row[-1][0] + row[-1][1] if row else 0
        if at < self.layout.columns:
            while at < self.layout.columns and self.busy.get(at, -1) >= len(self.rows) - 1:
                at += 1
            if high > 1:
                self.busy.update(dict.fromkeys(range(at, at + wide), len(self.rows) + high - 2))
        row.append((at, wide, text.split("\n")))

    def lines(self) -> Iterator[str]:
        rows = [r for r in self.rows if any(c != [""] for _, _, c in r)]
        columns = sorted({at for r in rows for at, _, _ in r})
        aligned = not columns or columns[-1] < self.layout.columns
        widths = dict.fromkeys(columns, 0)
        for r in rows if aligned else ():
            for at, wide, cell in r:
                if wide == 1:
                    widths[at] = max(widths[at], min(self.layout.pad, max(map(len, cell))))
        begin, x = {}, 0
        for c in columns:
            begin[c], x = x, x + widths[c] + 2
        for r in rows:
            for i in range(max(len(c) for _, _, c in r)):
                line: list[str] = []
                x = 0
                for at, _, cell in r:
                    if i < len(cell) and cell[i]:
                        gap = max(begin[at] - x, 2 if x else 0) if aligned else (2 if x else 0)
                        line.append(" " * gap + cell[i])
                        x += gap + len(cell[i])
                yield "".join(line)


def render(page: str | None, layout: Layout = LAYOUT) -> str:
    """All visible text of a page."""
    parts = list(events(page or ""))
    styles = Styles([parts[i + 1][1] for i, e in enumerate(parts[:-1]) if e[:2] == ("open", "style") and parts[i + 1][0] == "text"])
    flows, gone, pre, lists, tables = [_Flow()], 0, 0, [], []
    marks: list[tuple[bool, bool]] = []  # not rendered; what was visible around
    shown, drawn, selects = True, 0, []
    for kind, what, attrs in parts:
        flow = flows[-1]
        if kind == "text":
            if not gone and shown:
                flow.write(what, pre > 0)
            continue
        if kind == "open":
            named = attributes(attrs) if attrs else {}
            none, visible = styles.of(what, named) if named or styles.by else (False, None)
            none = none or what in UNSEEN or what == "input" or drawn > 0 and what in UNDRAWN or what == "dialog" and "open" not in named
            marks.append((none, shown))
            if visible is not None:
                shown = visible
            if none or gone:
                gone += none
                continue
            if what == "br":
                flow.end(0, shown)
            elif what in BLOCK:
                flow.end(2 if what in MARGIN and not lists else 1)
            if what == "pre":
                pre += 1
            elif what in ("ul", "ol", "menu"):
                start = INTEGER.match(named.get("start", ""))
                lists.append([what, int(start[1]) if start else 1])
                flow.indent = "  " * int(min(len(lists) - 1, layout.indent))
            elif what == "li":
                if lists and lists[-1][0] == "ol":
                    if shown:
                        flow.now.append(f"{lists[-1][1]}. ")
                    lists[-1][1] += 1
                elif shown:
                    flow.now.append("- ")
            elif what == "table":
                tables.append(_Table(layout) if len(tables) < layout.depth else None)
            elif what == "tr" and tables and tables[-1]:
                tables[-1].row()
            elif what in ("td", "th") and tables and tables[-1]:
                tables[-1].cell(named)
                flows.append(_Flow())
            elif what in ("td", "th") and tables and flow.now:
                flow.now.append("  ")
            elif what in ("svg", "math"):
                drawn += 1
            elif what == "text" and drawn:
                flow.end(1)
            elif what == "select":
                rows = INTEGER.match(named.get("size", ""))
                selects.append(("multiple" in named or bool(rows) and int(rows[1]) > 1, []))
                flows.append(_Flow())
            elif what == "option" and selects:
                selects[-1][1].append([("disabled" in named), "selected" in named, ""])
                flows.append(_Flow())
            elif what == "hr" and shown:
                flow.now.append("---")
                flow.end(2)
            continue
        none, around = marks.pop()
        was, shown = shown, around
        if none or gone:
            gone -= none
            continue
        if what in ("td", "th") and tables and tables[-1] and len(flows) > 1:
            tables[-1].put(flows.pop().text())
        elif what == "table" and tables:
            done = tables.pop()
            flow.end(2)
            for line in done.lines() if done else ():
                flow.now = [line]
                flow.end(1, True)
            flow.end(2)
        elif what == "option" and selects:
            selects[-1][1][-1][2] = flows.pop().text()
        elif what == "select" and selects:
            every, options = selects.pop()
            flows.pop()
            # a list box shows all options; else the last one selected shows, or the first that can be
            some = options if every else [x for x in options if x[1]][-1:] or [x for x in options if not x[0]][:1] or options[:1]
            for x in some if was else ():
                if every:
                    flows[-1].end(1)
                flows[-1].write(x[2], False)
            if every:
                flows[-1].end(1)
        elif what in ("svg", "math"):
            drawn -= 1
        elif what == "text" and drawn:
            flow.end(1)
        elif what in BLOCK:
            flow.end(2 if what in MARGIN and not lists else 1)
        if what == "pre":
            pre -= 1
        elif what in ("ul", "ol", "menu") and lists:
            lists.pop()
            flow.indent = "  " * int(min(max(0, len(lists) - 1), layout.indent))
            flow.gap = 1 if lists else 2
    while len(flows) > 1:
        inner = flows.pop().text()
        flows[-1].write(inner, True)
    return flows[0].text()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", layout: Layout = LAYOUT) -> DataFrame:
    """(id, text) of every page."""

    def run(batches):
        for some in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([render(x, layout) for _, x in some], pa.string())], [id_col, "text"])
        release()

    rows = pages.select(F.col(id_col).cast("bigint").alias(id_col), F.col(html_col))
    return rows.mapInArrow(run, f"`{id_col}` bigint, text string")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
