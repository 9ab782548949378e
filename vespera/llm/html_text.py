"""Visible text of HTML pages, laid out as a reader would see it.

A tree builder reads tags, closes elements whose end tags are implied, and tracks which subtrees are
visible. Blocks stand on lines of their own, with blank lines where their margins are; lists get
bullets or numbers and are indented; table cells are aligned in columns; pre keeps its spaces.

Unseen are UNSEEN (scripts, templates, and what shows only if something else fails to), FOREIGN_UNSEEN, closed dialogs and
details, and what display or visibility hide: the hidden attribute, an element's own style, and rules of the page's style
elements whose selectors are made of tags, classes and ids, joined in any number (p.a.b) and by descent or childhood (div p, ul > li);
other selectors and at-rules are not read.
What is visible again inside a part that visibility hides is rendered. All options of a select are rendered, a line each;
so are textarea, xmp and plaintext.

Null pages have null text and empty pages the empty text. Anything can follow a "<": what is no tag is
text; NUL characters become U+FFFD. Nesting depth and page length are not limited: there is no recursion, the open
elements are found by name, and work grows with the page's length. Three parameters bound what layout adds, alike for pages of any size:
indentation ends at max_indent blanks, markers stay; a table's column is as wide as its widest line of max_cell characters or fewer, and
what follows a longer line stands right behind it; columns that would begin beyond max_row characters are not aligned. Items of reversed lists
are counted by a first pass over pages that have such lists. Rows are independent. Input columns that clash with the operator's are replaced.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vespera.llm.common import bounded_batches, unused, without

COLUMNS = ("text", "title", "n_blocks", "n_links")
#: Element groups as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style template title noscript noframes noembed iframe object audio video canvas datalist".split())
#: Raw text that a reader sees, and what is unseen in pictures and formulas.
RAW_SEEN = frozenset("textarea xmp plaintext".split())
FOREIGN_UNSEEN = {"svg": frozenset("defs desc metadata symbol".split()), "math": frozenset("annotation annotation-xml".split())}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody thead tfoot tr td th caption ul textarea xmp plaintext".split()
)
MARGIN = frozenset("xmp plaintext p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr".split())
CLOSES_P = frozenset("xmp plaintext address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
#: start tag -> open elements it ends, and elements that this search does not leave.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}), "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
IN_HEAD = frozenset("head title base link meta style script noscript template html".split())
MAX_INDENT, MAX_CELL, MAX_ROW, BULLET = 40, 60, 400, "- "
LISTS = ("ul", "ol", "menu", "dir")

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+(?=>)|[^>]*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"(?:(?:\*|[a-z][\w-]*)(?:[.#][\w-]+)*|(?:[.#][\w-]+)+)(?:(?:\s*>\s*|\s+)(?:(?:\*|[a-z][\w-]*)(?:[.#][\w-]+)*|(?:[.#][\w-]+)+))*", re.I)
_COMPOUND = re.compile(r"(\s*>\s*|\s+)?(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_SPACES = re.compile(r"[ \t\n\r\f]+")


class _Flow:
    """Lines of one formatting context: a page's or a cell's."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a blank line is due before the next text
        self.space = False  # a space is due before the next word
        self.indent = ""
        self.lead = ""  # what stands before the marker
        self.marker = ""

    def text(self, s: str) -> None:
        t = _SPACES.sub(" ", s)
        if t == " " or not t:
            self.space = self.space or bool(t and self.line)
            return
        if (self.space or t[0] == " ") and self.line:
            self.line.append(" ")
        self.line.append(t.strip(" "))
        self.space = t[-1] == " "

    def end_line(self, keep_empty: bool = False) -> None:
        if self.line or keep_empty and self.lines:
            body = "".join(self.line)
            if body or self.marker:
                self.emit(body)
            elif not self.gap:
                self.lines.append("")
        self.line, self.space = [], False

    def emit(self, body: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = self.lead + self.marker if self.marker else self.indent
        self.marker = ""
        self.lines.append((lead + body).rstrip(" ") if body else lead.rstrip(" "))

    def margin(self) -> None:
        self.end_line()
        self.gap = bool(self.lines)

    def verbatim(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").split("\n")
        self.line.append(first)
        for part in rest:
            self.emit("".join(self.line))
            self.line = [part]

    def rendered(self) -> list[str]:
        self.end_line()
        if self.marker:
            self.emit("")
        return self.lines


class _Grid:
    """Where cells stand: columns that a cell of an earlier row still covers are left out. Runs of them are kept in order."""

    def __init__(self):
        self.runs: list[list[int]] = []  # first column, column after the last, row after the last

    def place(self, row: int, cells: list[tuple[list[str], int, int]]) -> list[tuple[int, int, list[str]]]:
        """(first column, columns spanned, lines) of a row's cells."""
        out, at, k, added = [], 0, 0, []
        for lines, span, deep in cells:
            while k < len(self.runs) and self.runs[k][0] <= at:
                first, end, until = self.runs[k]
                if until <= row:
                    del self.runs[k]
                    continue
                at = max(at, end)
                k += 1
            out.append((at, span, lines))
            if deep != 1:
                added.append([at, at + span, row + deep if deep else 1 << 62])
            at += span
        if added:
            self.runs = sorted([r for r in self.runs if r[2] > row] + added)
        return out


def _aligned(rows: list[list[tuple[list[str], int, int]]], max_cell: int, max_row: int) -> list[str]:
    """Rows of cells (lines, columns spanned, rows spanned) with columns as wide as their widest line that is not over max_cell."""
    grid = _Grid()
    placed = [grid.place(k, row) for k, row in enumerate(rows)]
    wide: dict[int, int] = {}
    for row in placed:
        for at, span, lines in row:
            if span == 1:
                wide[at] = max(wide.get(at, 0), max((len(x) for x in lines if len(x) <= max_cell), default=0))
    columns, ends = sorted(wide), [0]
    for c in columns:  # a column's width and the bar before it
        ends.append(ends[-1] + wide[c] + 3)
    upto = lambda at: min(ends[bisect_left(columns, at)], max_row)
    out = []
    for row in placed:
        for k in range(max((len(lines) for *_, lines in row), default=0)):
            if not any(k < len(lines) and lines[k].strip() for *_, lines in row):
                continue
            parts, done = [], 0
            for at, span, lines in row:
                if upto(at) > done:  # columns that are covered or missing
                    parts.append(" " * (upto(at) - done - 3))
                    done = upto(at)
                parts.append((lines[k] if k < len(lines) else "").ljust(max(0, upto(at + span) - done - 3)))
                done = max(done, upto(at + span))
            out.append(" | ".join(parts).rstrip(" "))
    return out


def _declared(style: str) -> dict[str, tuple[bool, bool]]:
    """property -> (whether it hides, whether it is important): what a style says of display and visibility; the last counts."""
    out: dict[str, tuple[bool, bool]] = {}
    for m in _DECLARED.finditer(style):
        name, value, important = m[1].lower(), m[2].lower(), bool(m[3])
        if important or not out.get(name, (False, False))[1]:
            out[name] = (value == "none" if name == "display" else value in ("hidden", "collapse")), important
    return out


class _Rules:
    """Selectors of a page's style elements that say something of display or visibility.

    A selector is a list of parts (whether it must be a child, tag or "", classes and ids). Each part is listed under one of its own marks, so
    an element looks at the parts under its id, its classes and its tag alone.
    """

    def __init__(self, page: str):
        self.known: dict[tuple, dict[str, tuple]] = {}  # of a selector, by property: (importance, weight, order), property, whether it hides
        self.listed: dict[str, list[tuple]] = {}
        self.order = 0
        for block in _style_blocks(page):
            for m in _RULE.finditer(block):
                if not (found := _declared(m[2])):
                    continue
                for selector in m[1].split(","):
                    if _SELECTOR.fullmatch(selector := selector.strip()):
                        parts = tuple(((c[1] or "").strip() == ">", (c[2] or "").lower().replace("*", ""), frozenset(re.findall(r"[.#][\w-]+", c[3]))) for c in _COMPOUND.finditer(selector) if c[2] or c[3])
                        self.add(parts, found)

    def add(self, parts: tuple, found: dict[str, tuple[bool, bool]]) -> None:
        marks = [m for _, _, of in parts for m in of]
        weight = (sum(m[0] == "#" for m in marks), sum(m[0] == "." for m in marks), sum(bool(tag) for _, tag, _ in parts))
        held = self.known.setdefault(parts, {})
        if not held:
            for i, (child, tag, of) in enumerate(parts):
                key = min(of, key=lambda m: (m[0] != "#", m)) if of else tag
                self.listed.setdefault(key, []).append((parts, i, child, tag, of))
        for prop, (hides, important) in found.items():  # of equal selectors the last counts, but for what an earlier one calls important
            self.order += 1
            if prop not in held or important >= held[prop][0][0]:
                held[prop] = ((important, weight, self.order), prop, hides)

    def met(self, name: str, attributes: dict[str, str], parent: tuple[frozenset, frozenset]) -> tuple[list, tuple[frozenset, frozenset]]:
        """What the selectors that an element meets say, as (importance, weight, order), property, whether it hides; and what its children need: the parts met by it, and by it and what holds it."""
        own = {*("." + c for c in attributes.get("class", "").split()), *(["#" + attributes["id"]] if attributes.get("id") else [])}
        here, said = [], []
        for key in (*own, name, ""):
            for parts, i, child, tag, of in self.listed.get(key, ()):
                if (not tag or tag == name) and of <= own and (not i or (id(parts), i - 1) in parent[not child]):
                    here.append((id(parts), i))
                    if i + 1 == len(parts):
                        said += self.known[parts].values()
        below = parent[1] if parent[1].issuperset(here) else parent[1].union(here)
        return said, (frozenset(here), below)


def _style_blocks(page: str) -> list[str]:
    """The text of each rule outside at-rules, of all style elements, without comments."""
    out, low, at = [], page.lower(), 0
    while (at := low.find("<style", at)) >= 0:
        begin = low.find(">", at) + 1
        end = low.find("</style", begin)
        if not begin or end < 0:
            break
        text, at = page[begin:end], end
        parts, k = [], 0
        while (c := text.find("/*", k)) >= 0:
            parts.append(text[k:c])
            k = text.find("*/", c + 2)
            k = len(text) if k < 0 else k + 2
        depth, start = 0, 0
        text = "".join([*parts, text[k:]])
        for m in re.finditer(r"[{}]", text):  # blocks inside blocks belong to at-rules
            depth = depth + 1 if m[0] == "{" else max(0, depth - 1)
            if depth == 0:
                block, start = text[start : m.end()], m.end()
                if block.count("{") == 1 and not block.lstrip().startswith("@"):
                    out.append(block)
    return out


class _Page:
    def __init__(self, rules: _Rules | None, counted: list[int] | None, bounds: tuple[int, int, int]):
        """counted: the items of each list that is numbered down to 1, as a first pass has found them."""
        self.open: list[tuple[str, bool, bool, object, tuple]] = []  # element, whether display shows it and visibility, what to restore at its end, parts of selectors met
        self.places: dict[str, list[int]] = {}  # of open elements, by name
        self.flows, self.tables = [_Flow()], []
        self.blocks = self.links = self.pre = 0
        self.title: list[str] = []
        self.rules, self.known, self.counted = rules, counted, []
        self.max_indent, self.max_cell, self.max_row = bounds

    @property
    def flow(self) -> _Flow:
        return self.flows[-1]

    def counts(self, name: str) -> int:
        return len(self.places.get(name, ()))

    def last(self, names) -> int:
        """The place of the innermost open element of names, -1 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def styled(self, found: dict[str, str], said: list, shown: bool, visible: bool) -> tuple[bool, bool]:
        """Whether display and visibility show an element, from what its attributes and its parent say, and the rules."""
        if found.get("style"):
            said = said + [((important, (1000, 0, 0), 0), prop, hides) for prop, (hides, important) in _declared(found["style"]).items()]
        for _, prop, hides in sorted(said):
            if prop == "display":
                shown = not hides
            else:
                visible = not hides
        return shown, visible

    def start(self, name: str, attributes: str, closed: bool) -> None:
        if name not in IN_HEAD and self.counts("head"):
            self.pop_until({"head"}, set())
        if name in CLOSES_P and self.counts("p"):
            self.pop_until({"p"}, {"td", "th", "table", "button"})
        if rule := ENDS.get(name):
            while any(self.counts(x) for x in rule[0]) and self.pop_until(*rule):
                pass
        foreign = [x for x in FOREIGN_UNSEEN if self.counts(x)]
        if closed and (foreign or name in FOREIGN_UNSEEN):
            return
        above, visible = self.open[-1][1:3] if self.open else (True, True)
        met, said = self.open[-1][4] if self.open else (frozenset(), frozenset()), []
        above = above and name not in UNSEEN and not any(name in FOREIGN_UNSEEN[x] for x in foreign)
        if self.open and self.open[-1][0] == "details" and name != "summary" and not self.open[-1][3]:
            above = False
        if name == "text" and foreign and above:
            self.characters(" ")
        found: dict[str, str] = {}
        if above and attributes.strip(" /\t\n"):
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        shown = above
        if above and (found or self.rules or name == "dialog"):
            own = not ("hidden" in found and found["hidden"].lower() != "until-found") and (name != "dialog" or "open" in found)
            if self.rules:
                said, met = self.rules.met(name, found, met)
            shown, visible = self.styled(found, said, own, visible)
        seen = shown and visible
        number = lambda key, otherwise: int(found[key]) if re.fullmatch(r"[+-]?[0-9]{1,9}", found.get(key, "").strip()) else otherwise
        if name == "input" and seen and found.get("type", "text").lower() in ("submit", "button", "reset"):
            self.flow.text(found.get("value", ""))
        if name == "img" and seen and found.get("alt"):
            self.flow.text(found["alt"])
        if name in VOID:
            if shown and name == "br":
                if self.flow.line or self.flow.marker:
                    self.flow.end_line()
                else:
                    self.flow.end_line(True)
            elif shown and name == "hr":
                self.flow.margin()
            return
        kept = None
        if shown:
            self.links += name == "a" and seen and "href" in found
            if name in BLOCK:
                if name in MARGIN and not (name in ("ul", "ol") and self.counts("li")):
                    self.flow.margin()
                elif name not in ("td", "th"):
                    self.flow.end_line()
                self.blocks += seen
            kept = self.enter(name, number, "reversed" in found, visible)
        if name == "details":
            kept = "open" in found
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append((name, shown, visible, kept, met))

    def enter(self, name: str, number, backwards: bool, visible: bool) -> object:
        flow = self.flow
        if name in LISTS:
            first = number("start", None if backwards else 1) if name == "ol" else None
            kept = {"next": first, "step": -1 if backwards else 1, "count": None}
            if name == "ol" and first is None:  # numbered down to 1
                kept["count"] = len(self.counted)
                kept["next"] = self.known[kept["count"]] if self.known else 0
                self.counted.append(0)
            return kept
        if name == "li":
            at = self.last(LISTS)
            own = self.open[at][3] if at >= 0 else None
            if flow.marker:
                flow.emit("")
            mark = BULLET
            if own and self.open[at][0] == "ol":
                if own["count"] is not None:
                    self.counted[own["count"]] += 1
                own["next"] = number("value", own["next"])
                mark = f"{own['next']}. "
                own["next"] += own["step"]
            before = flow.indent, flow.lead
            flow.lead, flow.marker = flow.indent, mark if visible else ""
            if len(flow.indent) < self.max_indent:
                flow.indent += " " * len(mark)
            return before
        if name in ("blockquote", "dd"):
            before = flow.indent
            flow.indent = (before + "  ") if len(before) < self.max_indent else before
            return before
        if name == "pre":
            self.pre += 1
        if name == "table":
            self.tables.append([])
            self.flows.append(_Flow())  # captions and stray text
        elif name == "tr" and self.tables:
            self.tables[-1].append([])
        elif name in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.flows.append(_Flow())
            deep = number("rowspan", 1)
            return max(1, min(1000, number("colspan", 1))), deep if 0 <= deep <= 65534 else 1
        return None

    def leave(self, name: str, shown: bool, kept: object) -> None:
        if not shown:
            return
        flow = self.flow
        if name in ("td", "th") and self.tables and kept:
            lines = self.flows.pop().rendered()
            if self.tables[-1]:
                self.tables[-1][-1].append((lines, *kept))
            return
        if name == "table" and self.tables:
            loose = self.flows.pop().rendered()
            rows = self.tables.pop()
            for line in [*loose, *_aligned(rows, self.max_cell, self.max_row)]:
                self.flow.emit(line)
            self.flow.margin()
            return
        if name == "pre":
            self.pre = max(0, self.pre - 1)
        if name in BLOCK:
            if name in MARGIN and not (name in ("ul", "ol") and self.counts("li")):
                flow.margin()
            else:
                flow.end_line()
        if name == "li":
            if flow.marker:
                flow.emit("")
            flow.indent, flow.lead = kept
        elif name in ("blockquote", "dd"):
            flow.indent = kept

    def pop(self) -> None:
        name, shown, _, kept, _ = self.open.pop()
        self.places[name].pop()
        self.leave(name, shown, kept)

    def pop_until(self, names: set[str], limits: set[str]) -> bool:
        """End the innermost open element of names, and all inside it, unless one of limits is in between."""
        at = self.last(names)
        if at < 0 or self.last(limits) > at:
            return False
        while len(self.open) > at:
            self.pop()
        return True

    def end(self, name: str) -> None:
        if name == "br":
            return self.start("br", "", False)
        if name == "p" and not self.counts("p"):
            self.start("p", "", False)
        if self.counts(name):
            inside = {"td", "th", "table"} if name not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html") else {"table"} if name != "table" else set()
            self.pop_until({name}, inside - {name})

    def characters(self, s: str) -> None:
        if self.open and not (self.open[-1][1] and self.open[-1][2]) or self.open and self.open[-1][0] == "details" and not self.open[-1][3]:
            return
        if self.pre:
            self.flow.verbatim(s)
        else:
            self.flow.text(s)


def render(page: str, max_indent: int = MAX_INDENT, max_cell: int = MAX_CELL, max_row: int = MAX_ROW) -> tuple[str, str | None, int, int]:
    """Text, title, number of blocks and of links of a page."""
    page = page.replace("\0", "\ufffd")
    rules, bounds = _Rules(page) if "<style" in page.lower() else None, (max_indent, max_cell, max_row)
    p = _built(page, rules, None, bounds)
    if p.counted:
        p = _built(page, rules, p.counted, bounds)
    return "\n".join(p.flow.rendered()).strip("\n"), p.title[0] if p.title else None, p.blocks, p.links


def _built(page: str, rules: _Rules | None, counted: list[int] | None, bounds: tuple[int, int, int]) -> _Page:
    p, at, n = _Page(rules, counted, bounds), 0, len(page)
    last = page.rfind(">")
    while at < n:
        if at > last and page[at] == "<" and page[at + 1 : at + 2] not in ("!", "?"):  # no tag can end any more
            p.characters(html.unescape(page[at:]))
            break
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if m[1]:
                p.end(name)
                if name == "text" and p.counts("svg"):
                    p.characters(" ")
                continue
            p.start(name, m[3], m[3].endswith("/"))
            if name in RAW:
                close = _CLOSE[name].search(page, at) if name != "plaintext" else None
                inner = page[at : close.start() if close else n]
                if name in RAW_SEEN:
                    p.pre += 1
                    p.characters(re.sub(r"\A\r?\n", "", html.unescape(inner)) if name == "textarea" else inner)
                    p.pre -= 1
                if name == "title" and not p.title:
                    p.title.append(_SPACES.sub(" ", html.unescape(inner)).strip())
                at = close.end() if close else n
                p.end(name)
        elif m[0][:2] not in ("<!", "<?"):
            p.characters(html.unescape(m[0]) if "&" in m[0] else m[0])
    while p.open:
        p.pop()
    while len(p.flows) > 1:
        lines = p.flows.pop().rendered()
        for line in lines:
            p.flow.emit(line)
    return p


def _render(bounds: tuple[int, int, int]):
    types = (pa.string(), pa.string(), pa.int64(), pa.int64())

    @F.arrow_udf("struct<text:string,title:string,n_blocks:long,n_links:long>")
    def rendered(page: pa.Array) -> pa.Array:
        rows = [render(x.as_py(), *bounds) if x.is_valid else (None,) * 4 for x in page]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], names=list(COLUMNS))

    return rendered


def extract_text(pages: DataFrame, html_column: str = "html", max_indent: int = MAX_INDENT, max_cell: int = MAX_CELL, max_row: int = MAX_ROW) -> DataFrame:
    """pages without their html, with text, title, n_blocks and n_links."""
    bounded_batches(pages.sparkSession)
    names = [c for c in without(pages, COLUMNS).columns if c != html_column]
    own = unused(pages, "rendered")
    out = pages.select(*names, _render((max_indent, max_cell, max_row))(F.col(html_column)).alias(own))
    return out.select(*names, *[F.col(own)[c].alias(c) for c in COLUMNS])
