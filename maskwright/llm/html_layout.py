"""Layout-aware text of HTML: what a reader of the page sees, in its blocks.

A forgiving tree builder implies the tags that pages leave out; visibility
rules decide what shows; each element is laid out as it closes: blocks on lines
of their own, with a blank line around paragraphs, headings, lists and tables,
markers and indents for lists, and cells padded so that columns line up.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import zip_longest
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import texts, unused

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist rp".split())
#: What svg and math define without drawing it.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu".split())
BLOCK = SPACED | frozenset("address article aside body center details dialog dd dir div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section select summary caption thead tbody tfoot tr td th".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: What an element's start closes, and the elements at which the search for it stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "td", "th", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: Name and value of an attribute; an unquoted value takes a slash at its end along.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?+""")
#: Most tags have none of the attributes that are read; rules of a page's style sheets read two more.
READ = re.compile("hidden|style|span|start|open|type", re.IGNORECASE)
#: Buttons that show their value.
BUTTONS = frozenset("submit button reset".split())
#: A rule without nested braces, and a selector of a tag, an id and classes.
RULE = re.compile(r"([^{}]*+)\{([^{}]*+)\}")
SELECTOR = re.compile(r"(\*|[a-z][a-z0-9-]*+)?((?:[.#][a-z0-9_\-\x80-\U0010ffff]++)*+)", re.IGNORECASE)
SHEET = re.compile(r"<!--.*?-->|<(script|textarea|xmp|title)\b.*?</\1\b|<style\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>(.*?)(?:</style\b|\Z)", re.IGNORECASE | re.DOTALL)
FOREIGN = ("svg", "math")
#: Elements of a table between which a form has no box.
TABLE = frozenset("table thead tbody tfoot tr".split())
GAP = "  "
ROWS = 128
# The spans to which the HTML standard clamps, and the largest number of a list.
COLUMNS, DOWN, INTEGER = 1000, 65534, 2**31 - 1


def attributes(rest: str, every: bool = False) -> dict[str, str]:
    """Values by name in lower case; of equal names the first counts. Tags without a name of READ have none, unless ``every`` is asked for."""
    found: dict[str, str] = {}
    if every or READ.search(rest):
        for m in ATTRIBUTE.finditer(rest):
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


#: Of a style, by property: whether it is important, and the value.
Declared = dict[str, tuple[bool, str]]


def declared(style: str) -> Declared:
    """What a style says of display and visibility; of a name the last counts, an important one before others."""
    values: Declared = {}
    for part in re.sub(r"/\*.*?\*/", "", style, flags=re.DOTALL).lower().split(";"):
        name, _, value = part.partition(":")
        bare, important, _ = value.partition("!")
        name = name.strip()
        if name in ("display", "visibility") and (important or not values.get(name, (False, ""))[0]):
            values[name] = bool(important), bare.strip()
    return values


@dataclass(frozen=True)
class Rule:
    """A rule of a style sheet with its place in the cascade."""

    rank: tuple[int, int, int, int]
    tag: str
    id: str
    classes: frozenset[str]
    values: Declared

    def fits(self, tag: str, of: dict[str, str], classes: frozenset[str]) -> bool:
        return (not self.tag or self.tag == tag) and (not self.id or self.id == of.get("id")) and self.classes <= classes


def style_rules(source: str) -> list[Rule]:
    """The rules of a page's style elements that say whether something shows, for tags, ids and classes.

    Rules inside at-rules, which depend on the medium, and selectors that look
    at other elements, attributes or states are left out.
    """
    rules: list[Rule] = []
    if not re.search("<style", source, re.IGNORECASE):
        return rules
    for sheet in SHEET.finditer(source):
        if sheet[3] is None or re.search(r"media\s*=\s*[\"']?\s*(?!all|screen)[a-z]", sheet[2], re.IGNORECASE):
            continue
        text = re.sub(r"/\*.*?\*/|<!--|-->", " ", sheet[3], flags=re.DOTALL)
        text = re.sub(r"@[^{};]*+(?:;|\{(?:[^{}]*+\{[^{}]*+\})*+[^{}]*+\})", " ", text)
        for names, body in RULE.findall(text):
            if values := declared(body):
                for name in map(str.strip, names.split(",")):
                    if name and (m := SELECTOR.fullmatch(name)):
                        ids, classes = re.findall("#([^.#]+)", m[2]), re.findall("[.]([^.#]+)", m[2])
                        tag = "" if m[1] in (None, "*") else m[1].lower()
                        if len(set(ids)) < 2:
                            rules.append(Rule((len(ids), len(classes), bool(tag), len(rules)), tag, ids[0] if ids else "", frozenset(classes), values))
    return rules


def closes_itself(rest: str) -> bool:
    """Whether a tag ends with a slash that is not part of an unquoted value."""
    if not rest.endswith("/"):
        return False
    return not any(m[4] and m.end() == len(rest) for m in ATTRIBUTE.finditer(rest))


def _number(value: str | None) -> int | None:
    """The integer that an attribute begins with; one beyond 2**31 is as large as that."""
    m = re.match(r"\s*([+-]?)0*(\d+)", value or "")
    return (-1 if m[1] == "-" else 1) * (int(m[2]) if len(m[2]) < 10 else INTEGER) if m else None


def _span(value: str | None, most: int) -> int:
    n = _number(value)
    return min(n, most) if n is not None and n > 0 else 1


def width(line: str) -> int:
    """Columns of a line: wide characters take two, marks that stand on others none."""
    if line.isascii():
        return len(line)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in line)


#: A laid-out cell: columns and rows that it takes, and its lines.
Cell = tuple[int, int, list[str]]


class Box:
    """An open element: its laid-out blocks ``(spaced, lines)`` and the line of text that is being filled."""

    __slots__ = ("blocks", "cells", "closed", "count", "down", "hidden", "line", "rows", "span", "tag", "unseen")

    def __init__(self, tag: str, hidden: bool, of: dict[str, str] | None = None, unseen: bool = False) -> None:
        #: ``hidden`` leaves out all that is inside; ``unseen`` hides texts, and elements inside can turn that off.
        self.tag, self.hidden, self.unseen = tag, hidden, unseen
        self.blocks: list[tuple[bool, list[str]]] = []
        self.line: list[str] = []
        self.rows: list[list[Cell]] = []
        self.cells: list[Cell] = []
        of = of or {}
        self.span = _span(of.get("colspan"), COLUMNS) if tag in ("td", "th") else 1
        # Zero rows are all that follow.
        self.down = (DOWN if _number(of.get("rowspan")) == 0 else _span(of.get("rowspan"), DOWN)) if tag in ("td", "th") else 1
        self.count = (1 if (n := _number(of.get("start"))) is None else n) - 1 if tag == "ol" else 0
        #: Shows no text of its own: a closed details element, of which the first summary shows, or a drawing, of which texts do.
        self.closed = tag == "details" and "open" not in of

    def flush(self, keep: bool = False) -> None:
        text, self.line = "".join(self.line), []
        lines = text.split("\n") if keep else [" ".join(part.split()) for part in text.split("\r")]
        while lines and not lines[0].strip():
            lines.pop(0)
        while lines and not lines[-1].strip():
            lines.pop()
        if lines:
            self.blocks.append((False, lines))

    def lines(self) -> list[str]:
        """All lines, with one blank line on each side of a spaced block that has a neighbour."""
        out, before = [], False
        for spaced, block in self.blocks:
            if out and (spaced or before):
                out.append("")
            out += block
            before = spaced
        return out


class Page:
    """The stack of open elements of one page."""

    def __init__(self, rules: list[Rule] | None = None) -> None:
        self.stack, self.open, self.rules = [Box("html", False)], Counter({"html": 1}), rules or []

    def shown(self, tag: str, of: dict[str, str]) -> tuple[bool, str]:
        """Whether an element is displayed, and its visibility if something declares it."""
        ranked = []
        if self.rules:
            classes = frozenset(of.get("class", "").split())
            ranked = [((r.rank[:3], r.rank[3]), r.values) for r in self.rules if r.fits(tag, of, classes)]
        if "style" in of:
            ranked.append((((9**9, 0, 0), 0), declared(of["style"])))
        won = {}
        for rank, values in ranked:
            for name, (important, value) in values.items():
                if name not in won or (important, rank) > won[name][0]:
                    won[name] = (important, rank), value
        display, visibility = (won.get(name, (None, ""))[1] for name in ("display", "visibility"))
        # A display that a rule gives shows what the hidden attribute hides.
        return display != "none" and not ("hidden" in of and not display), visibility

    def block(self) -> Box:
        return next(b for b in reversed(self.stack) if b.tag in BLOCK)

    def close(self) -> None:
        box = self.stack.pop()
        self.open[box.tag] -= 1
        if box.tag not in BLOCK:
            return
        box.flush(keep=box.tag == "pre")
        parent, lines = self.block(), box.lines()
        if box.hidden:
            return
        if box.tag in ("td", "th"):
            parent.cells.append((box.span, box.down, lines))
        elif box.tag == "tr":
            parent.rows.append(box.cells or [(1, 1, lines)])
            if box.cells:  # what stands in a row beside its cells shows before the table
                parent.blocks += box.blocks
        elif box.tag in ("thead", "tbody", "tfoot"):
            parent.rows += [*box.rows, *([box.cells] if box.cells else [])]
            parent.blocks += box.blocks
        else:
            if box.tag in ("table", "html", "body") or box.rows or box.cells:
                lines += aligned([*box.rows, *([box.cells] if box.cells else [])])
            if box.tag == "li":
                parent.count += 1
                mark = f"{parent.count}. " if parent.tag == "ol" else "- "
                lines = [mark + lines[0], *(" " * len(mark) + x if x else x for x in lines[1:])] if lines else []
            elif box.tag in ("dd", "blockquote"):
                lines = ["  " + x if x else x for x in lines]
            if lines:
                nested = box.tag in ("ul", "ol", "menu") and parent.tag == "li"
                parent.blocks.append((box.tag in SPACED and not nested, lines))

    def close_to(self, tags: set[str], stops: set[str] | frozenset[str], every: bool = False) -> None:
        """Close the nearest open element of these tags, or every one before a stop, and what is open in it."""
        if not any(self.open[t] > 0 for t in tags):
            return
        found = 0
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                found = k
            if self.stack[k].tag in stops or found and not every:
                break
        while found and len(self.stack) > found:
            self.close()

    def push(self, tag: str, rest: str = "") -> None:
        of = attributes(rest, bool(self.rules)) if rest else {}
        top = self.stack[-1]
        displayed, visibility = self.shown(tag, of) if of or self.rules else (True, "")
        first = tag == "summary" and not top.count
        hidden = top.hidden or tag in HIDDEN or top.tag == "details" and top.closed and not first or tag in UNDRAWN and self.foreign() or not displayed or tag == "dialog" and "open" not in of
        if top.tag == "details" and tag == "summary":
            top.count += 1
        if tag in BLOCK:
            parent = self.block()
            parent.flush(keep=parent.tag == "pre")
        unseen = visibility in ("hidden", "collapse") if visibility in ("hidden", "collapse", "visible") else top.unseen
        self.stack.append(Box(tag, hidden, of, unseen))
        if tag == "svg" or top.closed and top.tag != "details" and tag not in ("text", "foreignobject"):
            self.stack[-1].closed = True
        self.open[tag] += 1

    def foreign(self) -> bool:
        return any(self.open[t] > 0 for t in FOREIGN)

    def start(self, tag: str, rest: str) -> None:
        if tag == "text" and self.foreign() and not self.stack[-1].hidden:  # drawn at a place of its own
            self.block().line.append(" ")
        if tag in ("html", "body"):
            self.close_to({"head"}, frozenset())
            return
        if tag == "form" and self.block().tag in TABLE:
            return
        if tag not in IN_HEAD and tag != "head":
            self.close_to({"head"}, frozenset())
        if tag == "br":
            self.text("\n" if self.block().tag == "pre" else "\r", raw=True)
            return
        if tag in CLOSES_P:
            self.close_to({"p"}, {"td", "th", "table", "caption"})
        if tag in IMPLIED:
            self.close_to(*IMPLIED[tag], every=True)
            if tag in ("td", "th") and self.open["table"] > 0 and self.block().tag != "tr":
                self.push("tr")
        if tag == "hr":
            self.block().flush()
        if tag not in VOID:
            self.push(tag, rest)
        elif tag == "input":
            self.button(attributes(rest, bool(self.rules)))

    def button(self, of: dict[str, str]) -> None:
        """The value of a button, which is its text."""
        if of.get("type", "").strip().lower() not in BUTTONS or "value" not in of:
            return
        displayed, visibility = self.shown("input", of)
        if displayed and not (visibility in ("hidden", "collapse") or self.stack[-1].unseen and visibility != "visible"):
            top, unseen = self.stack[-1], self.stack[-1].unseen
            top.unseen = False
            self.text(" " + re.sub(r"\s", " ", of["value"]) + " ", raw=True)
            top.unseen = unseen

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag not in ("html", "body") and not (tag == "form" and self.block().tag in TABLE):
            stops = {"table"} if tag in IMPLIED else {"td", "th"} if tag not in ("table", "tr", "thead", "tbody", "tfoot") else frozenset()
            self.close_to({tag}, stops - {tag})

    def text(self, text: str, raw: bool = False) -> None:
        if not raw:
            if self.open["head"] > 0 and text.strip() and self.stack[-1].tag == "head":
                self.close_to({"head"}, frozenset())
            block = self.block()
            text = html.unescape(text)
            text = text if block.tag == "pre" else text.replace("\r", " ")
        top = self.stack[-1]
        if not top.hidden and not top.closed and not top.unseen:
            self.block().line.append(text)


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table whose columns start at the same place in each row.

    A wide cell takes several columns, and a tall one keeps its columns free in
    the rows below it.
    """
    widths: list[int] = []
    grid, tall = [], {}  # columns that cells above keep, with the rows that they still have
    for row in rows:
        at, spots, below = 0, [], {c: n - 1 for c, n in tall.items() if n > 1}
        for span, down, lines in row:
            while at in tall:
                at += 1
            widths += [-1] * (at + 1 - len(widths))
            widths[at] = max(widths[at], 0, *map(width, lines)) if span == 1 else max(widths[at], 0)
            spots.append((at, lines))
            if down > 1:
                below.update(dict.fromkeys(range(at, at + span), down - 1))
            at += span
        grid.append(spots)
        tall = below
    # A column in which no cell starts has no place of its own.
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + (w + len(GAP) if w >= 0 else 0))
    out = []
    for spots in grid:
        for parts in zip_longest(*(lines for _, lines in spots), fillvalue=""):
            line = ""
            for (at, _), part in zip(spots, parts, strict=True):
                if part:
                    line += " " * max(starts[at] - width(line), len(GAP) if line else 0) + part
            if line := line.rstrip():
                out.append(line)
    return out


def visible_text(source: str) -> str:
    """All visible text of a page."""
    page, at, n = Page(style_rules(source)), 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            page.text(source[at:lt])
        if lt == n:
            break
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif source[lt + 1 : lt + 2] in ("!", "?"):
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
        elif re.match(r"</?[a-zA-Z]", source[lt : lt + 3]):
            m = TAG.match(source, lt)
            if m:
                close, tag, rest, at = m[1], m[2].lower(), m[3], m.end()
            else:  # a quote is left open: the tag ends at the next bracket
                end = source.find(">", lt)
                if end < 0:
                    break
                name = re.match(r"<(/?)([a-zA-Z][^\s/>]*)", source[lt:end])
                close, tag, rest, at = name[1], name[2].lower(), source[lt + name.end() : end], end + 1
            if close:
                page.end(tag)
                continue
            if (tag in FOREIGN or page.foreign()) and closes_itself(rest):
                continue
            page.start(tag, rest)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
                page.text(source[at : end.start() if end else n], raw=tag not in ("textarea", "title"))
                at = end.start() if end else n
        else:
            page.text("<")
            at = lt + 1
    while len(page.stack) > 1:
        page.close()
    root = page.stack[0]
    root.flush()
    return "\n".join([*root.lines(), *aligned([*root.rows, *([root.cells] if root.cells else [])])])


def _extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, part.num_rows, ROWS):
            rows = part.slice(at, ROWS)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array([visible_text(t) for t in texts(rows.columns[-1])], pa.string())], [*rows.schema.names[:-1], "text"])


def extracted(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """One row per input row: the key columns and ``text``, the visible text.

    A null, empty or invisible page has the empty text. Markup of any kind is
    taken: what is left open is closed at the end, and what closes nothing is
    ignored. Repeated rows each get a row; an empty table gives an empty table;
    other columns are not read.
    """
    (made,) = unused(list(keys), 1)
    rows = pages.select(*keys, F.col(html_col).alias(made))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_extract, f"{kinds}, text string")
