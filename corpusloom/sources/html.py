"""Web pages to text nodes with their paths."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements without content, and elements whose text is not page text.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param",
    "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer",
}
NO_TEXT = {"script", "style", "template"}
PAGES = 64


class _Tree(HTMLParser):
    """Elements as [name, parent, same-name position]; texts as (element, text) in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = [["", -1, 0]]
        self.counts: dict[tuple[int, str], int] = {}
        self.open = [0]
        self.texts: list[tuple[int, str]] = []
        self.pending: list[str] = []

    def flush(self) -> None:
        text, self.pending = "".join(self.pending), []
        at = self.open[-1]
        if text and self.elements[at][0] not in NO_TEXT:
            text = html.unescape(text).strip()
            if text:
                self.texts.append((at, text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        parent = self.open[-1]
        place = self.counts[parent, tag] = self.counts.get((parent, tag), 0) + 1
        self.elements.append([tag, parent, place])
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        for depth in range(len(self.open) - 1, 0, -1):
            if self.elements[self.open[depth]][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_decl(self, decl: str) -> None:
        self.flush()

    def path(self, at: int) -> str:
        parts = []
        while at:
            tag, parent, place = self.elements[at]
            parts.append(tag if self.counts[parent, tag] == 1 else f"{tag}[{place}]")
            at = parent
        return "".join("/" + p for p in reversed(parts))


def page_nodes(page: str) -> list[tuple[str, str]]:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    tree.flush()
    return [(text, tree.path(at)) for at, text in tree.texts if at]


def html_nodes(pages: DataFrame, page_id: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, ord, text, xpath): one row per text node; unclosed elements nest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # nodes take many times the room of their pages: few pages at once
            for start in range(0, len(pdf), PAGES):
                part = pdf.iloc[start : start + PAGES]
                rows = [
                    (ident, i, text, path)
                    for ident, page in zip(part[page_id], part[html_col])
                    for i, (text, path) in enumerate(page_nodes(page))
                ]
                yield pd.DataFrame(rows, columns=["page_id", "ord", "text", "xpath"])

    return pages.select(page_id, html_col).mapInPandas(run, "page_id long, ord int, text string, xpath string")
