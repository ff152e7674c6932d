"""Elements of HTML pages: a tree from tags in one pass, and CSS selectors matched over it in one pass each."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.shipping import map_arrow

#: Elements without content and end tag.
VOID = {
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param",
    "source", "spacer", "track", "wbr",
}
_COMPOUND = re.compile(r"""([\w-]+|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$]?=)\s*["']?([^"'\]]*?)["']?\s*(i?)\s*)?\]""")


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parent: int  # -1 at the top
    first_text: int
    last: int = -1  # the last element inside, itself if none
    end_text: int = -1


class Page(HTMLParser):
    """The elements of a page in the order of their start tags, and its texts.

    An end tag closes the nearest open element of its name and all inside it, or nothing if none is open; what is
    left open ends with the page. Scripts and styles have no text.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self._open: list[int] = []
        self._count: Counter[str] = Counter()
        self._found: dict[str, list[int]] = {}
        self._pending: list[str] = []
        self.feed(html)
        self.close()
        self._end_text()
        while self._open:
            self._close_last()

    def _end_text(self) -> None:
        """Text goes on over signs that are no tags, and ends at tags and comments."""
        text = "".join(self._pending).strip()
        if text and not (self._open and self.elements[self._open[-1]].tag in ("script", "style")):
            self.texts.append(text)
        self._pending.clear()

    def _close_last(self) -> None:
        e = self.elements[self._open.pop()]
        e.last, e.end_text = len(self.elements) - 1, len(self.texts)
        self._count[e.tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._end_text()
        self.elements.append(Element(tag, {k: v or "" for k, v in reversed(attrs)}, self._open[-1] if self._open else -1, len(self.texts)))
        self._open.append(len(self.elements) - 1)
        self._count[tag] += 1
        if tag in VOID:
            self._close_last()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close_last()

    def handle_endtag(self, tag: str) -> None:
        self._end_text()
        if self._count[tag]:
            while self.elements[self._open[-1]].tag != tag:
                self._close_last()
            self._close_last()

    def handle_data(self, data: str) -> None:
        self._pending.append(data)

    def handle_comment(self, data: str) -> None:
        self._end_text()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def text(self, at: int, sep: str = "") -> str:
        e = self.elements[at]
        return sep.join(self.texts[e.first_text : e.end_text])

    def select(self, selector: str) -> list[int]:
        """Elements that match, in order. Each step of a selector is a bit; an element's ancestors hand theirs down."""
        if selector in self._found:
            return self._found[selector]
        hits: set[int] = set()
        for steps in parsed(selector):
            own, above, last = [0] * len(self.elements), [0] * len(self.elements), 1 << (len(steps) - 1)
            for k, e in enumerate(self.elements):
                p = e.parent
                if p >= 0:
                    above[k] = above[p] | own[p]
                for i, (child, compound) in enumerate(steps):
                    before = 1 if i == 0 else ((own[p] if child else above[k]) >> (i - 1)) & 1 if p >= 0 else 0
                    if before and compound.matches(e):
                        own[k] |= 1 << i
                if own[k] & last:
                    hits.add(k)
        self._found[selector] = sorted(hits)
        return self._found[selector]

    def within(self, selector: str, at: int) -> list[int]:
        """Those inside an element (-1: the page); it itself for an empty selector. ``a >> b``: b inside the first a."""
        head, _, rest = selector.partition(" >> ")
        if not head:
            return [at]
        found = self.select(head)
        inside = found if at < 0 else found[bisect_left(found, at + 1) : bisect_right(found, self.elements[at].last)]
        return self.within(rest, inside[0]) if rest and inside else [] if rest else inside


@dataclass(frozen=True)
class Compound:
    """What a step of a selector asks of one element."""

    tag: str = "*"
    classes: tuple[str, ...] = ()
    ident: str = ""
    attrs: tuple[tuple[str, str, str, bool], ...] = ()

    def matches(self, e: Element) -> bool:
        if self.tag not in ("*", e.tag) or self.ident and e.attrs.get("id") != self.ident:
            return False
        if self.classes and not set(self.classes) <= set(e.attrs.get("class", "").split()):
            return False
        return all(self._holds(e.attrs.get(name), sign, value, fold) for name, sign, value, fold in self.attrs)

    @staticmethod
    def _holds(has: str | None, sign: str, value: str, fold: bool) -> bool:
        if has is None:
            return False
        has, value = (has.lower(), value.lower()) if fold else (has, value)
        return {"": True, "=": has == value, "*=": bool(value) and value in has, "^=": bool(value) and has.startswith(value), "$=": bool(value) and has.endswith(value)}[sign]


@cache
def parsed(selector: str) -> list[list[tuple[bool, Compound]]]:
    """Alternatives of a selector, each a list of (is a child of the one before, compound)."""
    out = []
    for alternative in selector.split(","):
        steps, child = [], False
        for token in alternative.replace(">", " > ").split():
            if token == ">":
                child = True
                continue
            tag, ident, classes, attrs = "*", "", [], []
            for m in _COMPOUND.finditer(token):
                if m[1]:
                    tag = m[1]
                elif m[2]:
                    classes.append(m[2])
                elif m[3]:
                    ident = m[3]
                else:
                    attrs.append((m[4], m[5] or "", m[6] or "", bool(m[7])))
            steps.append((child, Compound(tag, tuple(classes), ident, tuple(attrs))))
            child = False
        out.append(steps)
    return out


@dataclass(frozen=True)
class Field:
    """Where a value stands in a container: the first match of the first selector that has one; its text, or an attribute.

    ``like``: the text, in lower case, must hold this. ``where``: an attribute must equal a template over earlier fields.
    Strings of a text are joined by ``sep``; ``every``: so are the texts of all matches.
    """

    selectors: tuple[str, ...]
    attr: str = ""
    like: str = ""
    where: tuple[str, str] = ("", "")
    sep: str = ""
    every: bool = False

    def value(self, page: Page, at: int, earlier: dict[str, str]) -> str | None:
        for selector in self.selectors:
            found = page.within(selector, at)
            if self.every and found:
                return self.sep.join(filter(None, map(page.text, found)))
            for k in found:
                e = page.elements[k]
                if self.where[0] and e.attrs.get(self.where[0]) != self.where[1].format(**earlier):
                    continue
                text = page.text(k, self.sep) if not self.attr or self.like else ""
                if self.like and not re.search(self.like, text.lower()):
                    continue
                return e.attrs.get(self.attr) if self.attr else text
        return None


@dataclass(frozen=True)
class Strategy:
    """One way to read a page: its containers (the first selector that has any) and their fields.

    ``inside``: only containers in the first element that matches this and has one. ``text_like``: containers
    whose text starts like this.
    """

    containers: tuple[str, ...]
    fields: dict[str, Field] = field(default_factory=dict)
    inside: str = ""
    text_like: str = ""

    def found(self, page: Page) -> list[int]:
        for selector in self.containers:
            if not selector:
                return [-1]  # the page
            if self.inside:
                held = next((x for k in page.select(self.inside) if (x := page.within(selector, k))), [])
            else:
                held = page.select(selector)
            if self.text_like:
                held = [k for k in held if re.match(self.text_like, page.text(k))]
            if held:
                return held
        return []


_ROW = pa.schema([("page_id", pa.int64()), ("strategy", pa.int32()), ("pos", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])


def containers(pages: DataFrame, strategies: tuple[Strategy, ...]) -> DataFrame:
    """``page_id``, ``strategy``, ``pos`` (both from 1) and ``fields`` of every container on ``pages`` (``page_id``, ``html``).

    All strategies are tried; which one counts is for the caller. A null page has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows, page = [], Page(batch.column(1)[at].as_py() or "")
                for s, strategy in enumerate(strategies, start=1):
                    for pos, k in enumerate(strategy.found(page), start=1):
                        values: dict[str, str] = {}
                        for name, spec in strategy.fields.items():
                            if (value := spec.value(page, k, values)) is not None:
                                values[name] = value
                        rows.append({"page_id": batch.column(0)[at].as_py(), "strategy": s, "pos": pos, "fields": list(values.items())})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    return map_arrow(pages.select("page_id", "html"), run, "page_id long, strategy int, pos int, fields map<string,string>")
