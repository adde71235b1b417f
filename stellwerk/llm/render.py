"""Layout-aware rendering of markup: the visible text of a page as it stands on a screen.

A tree builder closes what HTML lets authors leave open (implied end tags), visibility rules drop what is not shown,
and the renderer keeps the layout that carries meaning: blocks are set apart, list items have their markers and depth,
table cells are aligned in columns, preformatted text stays as it is.

Defined results: null gives null; text without HTML tags comes out as it is, line for line; in markup, unknown tags are inline;
whatever is unclosed at the end is closed there; nesting is followed to any depth without recursion.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements by how they are laid out, and which open elements a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style template noscript head title svg canvas iframe object select datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset form hr".split())
BLOCK = SPACED | frozenset("div section article main header footer nav aside address li dt dd tr caption thead tbody tfoot body html details summary legend".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
# Elements that keep a start tag from closing anything beyond them.
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_KNOWN = "|".join(sorted(BLOCK | VOID | UNSEEN | frozenset("a abbr b big button center cite code em font i label mark q s small span strong sub sup td th tt u".split())))
#: What makes a text markup: a tag that HTML has. Words in angle brackets are text.
MARKUP = rf"(?i)</?(?:{_KNOWN})(?:\s[^<>]*)?/?>|<!--|<!doctype\s"
_TAG = re.compile(MARKUP)


class Node:
    __slots__ = ("tag", "shown", "start", "children")

    def __init__(self, tag: str, shown: bool = True, start: int = 1) -> None:
        self.tag, self.shown, self.start = tag, shown, start
        self.children: list[Node | str] = []


class TreeBuilder(HTMLParser):
    """Markup to a tree, with the end tags that authors may leave out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("body")
        self.open = [self.root]

    def _close_to(self, depth: int) -> None:
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and tag not in ("li", "dt", "dd", "tr", "thead", "tbody", "tfoot", "caption"):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == "p":
                    self._close_to(k)
                    break
                if self.open[k].tag in BLOCK or self.open[k].tag in ("td", "th"):
                    break
        closes, scope = CLOSES.get(tag, ()), SCOPES.get(tag, ())
        for k in range(len(self.open) - 1, 0, -1) if closes else ():
            if self.open[k].tag in scope:
                break
            if self.open[k].tag in closes:
                self._close_to(k)
        a = {k: v or "" for k, v in attrs}
        shown = tag not in UNSEEN and "hidden" not in a and a.get("aria-hidden") != "true" and not _HIDDEN.search(a.get("style", "")) and not (tag == "input")
        node = Node(tag, shown, int(a["start"]) if a.get("start", "").isdigit() and len(a["start"]) < 9 else 1)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._close_to(k)
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


class _Page:
    """Collects lines; ``gap`` is the number of line ends due before the next text."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap = 0
        self.blank = True
        self.lead = ""

    def end_line(self, gap: int) -> None:
        if self.parts:
            self.gap = max(self.gap, gap)
        self.blank = True

    def text(self, s: str) -> None:
        s = re.sub(r"[ \t\r\n\f]+", " ", s)
        if self.blank or self.gap:
            s = s.lstrip(" ")
        if not s:
            return
        if self.gap:
            while self.parts and not self.parts[-1].strip(" ") and "\n" not in self.parts[-1]:
                self.parts.pop()
            if self.parts:
                self.parts[-1] = self.parts[-1].rstrip(" ")
            self.parts.append("\n" * self.gap)
            self.gap = 0
        if self.lead:
            self.parts.append(self.lead)
            self.lead = ""
        self.parts.append(s)
        self.blank = s.endswith(" ")

    def raw(self, s: str) -> None:
        self.end_line(2)
        self.parts.append("\n" * (self.gap if self.parts else 0) + s.strip("\n"))
        self.gap = 2
        self.blank = True


def _table(node: Node) -> str:
    rows: list[list[str]] = []
    todo: list[Node] = [node]
    while todo:
        n = todo.pop(0)
        if not n.shown:
            continue
        if n.tag == "tr":
            rows.append([" ".join(render_tree(c).split()) for c in n.children if isinstance(c, Node) and c.shown and c.tag in ("td", "th")])
        else:
            todo[:0] = [c for c in n.children if isinstance(c, Node) and (c.tag in ("tr", "thead", "tbody", "tfoot", "caption"))]
    rows = [r for r in rows if any(r)]
    width = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(max(map(len, rows), default=0))]
    return "\n".join("  ".join(c.ljust(width[k]) for k, c in enumerate(r)).rstrip() for r in rows)


def render_tree(root: Node) -> str:
    """The visible text below a node."""
    page = _Page()
    counters: list[int | None] = []
    todo: list[tuple[str, Node | str]] = [("in", c) for c in reversed(root.children)]
    while todo:
        step, n = todo.pop()
        if isinstance(n, str):
            page.text(n)
            continue
        if step == "out":
            if n.tag in ("ul", "ol"):
                counters.pop()
            page.end_line(2 if n.tag in SPACED and not (n.tag in ("ul", "ol") and counters) else 1)
            page.lead = ""
            continue
        if not n.shown:
            continue
        if n.tag == "br":
            page.end_line(1 if not page.gap else page.gap + 1)
            continue
        if n.tag == "pre":
            page.raw("".join(c if isinstance(c, str) else render_tree(c) for c in n.children))
            continue
        if n.tag == "table":
            if body := _table(n):
                page.raw(body)
            continue
        if n.tag in BLOCK:
            page.end_line(2 if n.tag in SPACED and not (n.tag in ("ul", "ol") and counters) else 1)
            if n.tag in ("ul", "ol"):
                counters.append(n.start if n.tag == "ol" else None)
            elif n.tag == "li":
                number = counters[-1] if counters else None
                page.lead = "  " * (max(1, len(counters)) - 1) + ("- " if number is None else f"{number}. ")
                if number is not None:
                    counters[-1] = number + 1
            todo.append(("out", n))
        todo.extend(("in", c) for c in reversed(n.children))
    return "".join(page.parts).rstrip()


def render(markup: str | None) -> str | None:
    """The visible text of markup; a text without tags is its own."""
    if markup is None or not _TAG.search(markup):
        return markup
    builder = TreeBuilder()
    builder.feed(markup)
    builder.close()
    return render_tree(builder.root)


def rendered(markup: Column) -> Column:
    """``render`` over a column; only rows that look like markup leave the JVM."""

    @F.arrow_udf(T.StringType())
    def run(text: pa.Array) -> pa.Array:
        return pa.array([render(x) for x in text.to_pylist()], pa.string())

    return F.when(F.rlike(markup, F.lit(MARKUP)), run(markup)).otherwise(markup)
