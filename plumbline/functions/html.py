"""Readable blocks of HTML pages, per Arrow batch."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.blocks import tidy

# Block tags, dropped tags, roots in order of preference and tags without content.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCK_TAGS = ("p", "li", "table")
DROPPED_TAGS = ("script", "style", "nav", "footer", "noscript", "form")
ROOTS = ("main", "article", "body")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

HTML_BLOCK = T.StructType(
    [T.StructField("section", T.StringType()), T.StructField("text", T.StringType()), T.StructField("element", T.StringType())]
)


class Outline(HTMLParser):
    """Flat list of elements with their extent in a list of text runs.

    An element is (name, first run, end run, parent). An end tag closes everything opened since
    its start tag; tags are not closed implicitly, so an unclosed paragraph runs on.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.runs: list[str] = []
        self.elements: list[list] = []
        self.open: list[int] = []
        self.open_names: Counter[str] = Counter()

    def parent(self) -> int | None:
        return self.open[-1] if self.open else None

    def handle_starttag(self, tag, attrs):
        self.elements.append([tag, len(self.runs), None, self.parent()])
        if tag not in VOID_TAGS:
            self.open.append(len(self.elements) - 1)
            self.open_names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.elements.append([tag, len(self.runs), len(self.runs), self.parent()])

    def handle_endtag(self, tag):
        closed = None if self.open_names[tag] else tag
        while closed != tag:
            element = self.elements[self.open.pop()]
            element[2] = len(self.runs)
            closed = element[0]
            self.open_names[closed] -= 1

    def handle_data(self, data):
        self.runs.append(data)


def outline_blocks(html: str) -> list[dict]:
    page = Outline()
    page.feed(html)
    page.close()
    end = len(page.runs)
    rows = [(tag, start, end if stop is None else stop, up) for tag, start, stop, up in page.elements]
    root = next((i for name in ROOTS for i, row in enumerate(rows) if row[0] == name), None)

    # Whether an element lies below the root, below a dropped element of the root and below a list item.
    inside, dropped, listed = bytearray(len(rows)), bytearray(len(rows)), bytearray(len(rows))
    for i, (*_, up) in enumerate(rows):
        inside[i] = root is None or up is not None and (up == root or inside[up])
        if up is not None:
            dropped[i] = dropped[up] or (root is None or up > root) and rows[up][0] in DROPPED_TAGS
            listed[i] = listed[up] or rows[up][0] == "li"

    hidden = bytearray(end)
    for i, (tag, start, stop, _) in enumerate(rows):
        if tag in DROPPED_TAGS and inside[i]:
            hidden[start:stop] = b"\1" * (stop - start)

    def text_of(start: int, stop: int, glue: str) -> str:
        shown = (page.runs[i].strip() for i in range(start, stop) if not hidden[i])
        return tidy(glue.join(s for s in shown if s))

    blocks, section = [], None
    for i, (tag, start, stop, _) in enumerate(rows):
        if tag not in HEADINGS and tag not in BLOCK_TAGS or not inside[i] or dropped[i]:
            continue
        text = text_of(start, stop, " ")
        if not text:
            continue
        if tag in HEADINGS:
            section = text
        elif not (tag == "p" and listed[i]):
            blocks.append({"section": section, "text": text, "element": tag})
    if not blocks:
        first, last = (0, end) if root is None else rows[root][1:3]
        text = text_of(first, last, "\n")
        if text:
            blocks.append({"section": None, "text": text, "element": "body"})
    return blocks


@F.pandas_udf(T.ArrayType(HTML_BLOCK))
def html_blocks(pages: pd.Series) -> pd.Series:
    """Headed paragraphs, list items and tables of each page, without navigation and scripts."""
    return pages.map(outline_blocks, na_action="ignore")
