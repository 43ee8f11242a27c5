"""HTML for the scanner: text slots grouped by their nearest block, attributes, style and script bodies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from palimpsest.sources.opc import _map

#: Elements that hold a paragraph (fixed values).
BLOCKS = frozenset(("p", "div", "li", "td", "th", "body", "h1", "h2", "h3", "pre"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SLOTS_SCHEMA = "source string, block int, ord int, kind string, name string, text string"


class Slots(HTMLParser):
    """(block, ord, kind, name, text): kind is text, attribute or code (style and script, scan-only)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, str, str | None, str]] = []
        self.stack: list[tuple[str, int]] = []
        self.blocks = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = self.stack[-1][1] if self.stack else 0
        if tag in BLOCKS:
            self.blocks += 1
            block = self.blocks
            if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:
                self.stack.pop()
        for k, v in attrs:
            if v:
                self.rows.append((block, len(self.rows), "attribute", k, v))
        if tag not in VOID:
            self.stack.append((tag, block))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        inside = {t for t, _ in self.stack}
        code = bool(inside & {"script", "style"})
        self.rows.append((self.stack[-1][1] if self.stack else 0, len(self.rows), "code" if code else "text", None, data))


def slots(page: str) -> list[tuple[int, int, str, str | None, str]]:
    parser = Slots()
    parser.feed(page)
    parser.close()
    return parser.rows


def slots_of(pages: DataFrame, source: str, html: str) -> DataFrame:
    """SLOTS_SCHEMA."""

    def make(name: str, page: str | None) -> Iterator[tuple]:
        for row in slots(page or ""):
            yield name, *row

    return _map(pages.selectExpr(f"cast(`{source}` as string) as source", f"`{html}` as html"), SLOTS_SCHEMA, make)


class Spans(HTMLParser):
    """Text tokens with their places in the page: (block, begin, end, text, code)."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=False)
        self.starts = [0]
        for line in page.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.page, self.tokens, self.stack, self.blocks = page, [], [], 0
        self.feed(page)
        self.close()

    def _add(self, raw: str, text: str) -> None:
        line, column = self.getpos()
        begin = self.starts[line - 1] + column
        code = any(t in ("script", "style") for t, _ in self.stack)
        self.tokens.append((self.stack[-1][1] if self.stack else 0, begin, begin + len(raw), text, code))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = self.stack[-1][1] if self.stack else 0
        if tag in BLOCKS:
            self.blocks += 1
            block = self.blocks
            if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:
                self.stack.pop()
        if tag not in VOID:
            self.stack.append((tag, block))

    handle_endtag = Slots.handle_endtag

    def handle_data(self, data: str) -> None:
        self._add(data, data)

    def handle_entityref(self, name: str) -> None:
        self._ref(f"&{name}")

    def handle_charref(self, name: str) -> None:
        self._ref(f"&#{name}")

    def _ref(self, raw: str) -> None:
        line, column = self.getpos()
        at = self.starts[line - 1] + column + len(raw)
        raw += ";" if self.page[at : at + 1] == ";" else ""
        self._add(raw, unescape(raw))


def clean(page: str, pattern: re.Pattern, block: bool = False, only: set[int] | None = None) -> str:
    """The page without what matches in a block's joined text (in block mode: without that block's text); tags,
    attributes, scripts and styles stay as they are. only: the blocks that may change."""
    groups: dict[int, list[tuple[int, int, str]]] = {}
    for owner, begin, end, text, code in Spans(page).tokens:
        if not code:
            groups.setdefault(owner, []).append((begin, end, text))
    edits = []
    for owner, tokens in groups.items():
        whole = "".join(t for _, _, t in tokens)
        hits = [m.span() for m in pattern.finditer(whole)]
        if not hits or (only is not None and owner not in only):
            continue
        at = 0
        for begin, end, text in tokens:
            cut = [(max(a, at) - at, min(b, at + len(text)) - at) for a, b in ([(0, len(whole))] if block else hits) if a < at + len(text) and b > at]
            at += len(text)
            if cut:
                kept, place = [], 0
                for a, b in cut:
                    kept.append(text[place:a])
                    place = b
                edits.append((begin, end, escape("".join(kept) + text[place:], quote=False)))
    out, at = [], 0
    for begin, end, new in sorted(edits):
        out += [page[at:begin], new]
        at = end
    return "".join(out) + page[at:]
