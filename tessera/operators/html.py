"""HTML to text, and text to report items."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..settings import BLOCK_TAGS, CELL_TAGS, ITEM_SEPARATOR, ITEMS

VOID = {"br", "hr"}

#: What a start tag ends if it is open, and the elements beyond which it ends nothing.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "table"}),
    "td": ({"td", "th", "p"}, {"table", "tr"}),
    "th": ({"td", "th", "p"}, {"table", "tr"}),
    "tr": ({"td", "th", "tr", "p"}, {"table"}),
    "dt": ({"dt", "dd", "p"}, {"dl", "table"}),
    "dd": ({"dt", "dd", "p"}, {"dl", "table"}),
    "option": ({"option"}, {"select"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"td", "th", "tr", "thead", "tbody", "tfoot", "p"}, {"table"})),
}
PARAGRAPH = ({"p"}, {"table", "td", "th"})  # what any block ends


class _Text(HTMLParser):
    """Collects text; a cell's end adds a blank, a block's end a line feed, so that styled parts of a word join.

    Elements may be left open: a start tag ends those that can't hold it, an end tag those inside, the page all.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: str | None = None
        self.open: list[str] = []

    def end_from(self, depth: int) -> None:
        for tag in reversed(self.open[depth:]):
            if tag in CELL_TAGS:
                self.out.append(" ")
            elif tag in BLOCK_TAGS:
                self.out.append("\n")
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in ("script", "style"):
            self.hidden = tag
            return
        ended, barrier = ENDS.get(tag, PARAGRAPH if tag in BLOCK_TAGS else ((), ()))
        if ended:
            depth = len(self.open)
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k] in ended:
                    depth = k
                if self.open[k] in barrier:
                    break
            self.end_from(depth)
        if tag in VOID:
            self.out.append("\n")
        else:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.hidden == tag:
            self.hidden = None
        elif tag not in VOID and not self.hidden:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = None if tag == self.hidden else self.hidden
        elif tag in self.open:
            self.end_from(len(self.open) - 1 - self.open[::-1].index(tag))
        elif tag == "p":  # stands for an empty paragraph
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def close(self):
        super().close()
        self.end_from(0)


def page_text(html: str | None) -> str | None:
    """Readable text of a page: no scripts, styles, comments or document type; entities decoded; white space collapsed."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    text = "".join(parser.out).replace(" ", " ")
    return re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


_HEADINGS = [(k, number, re.compile(rf"Item\s+{number}{ITEM_SEPARATOR}{words}", re.IGNORECASE)) for k, (number, words, _, _) in enumerate(ITEMS)]


def item_sections(text: str | None) -> list[tuple[str, str]]:
    """Items and their texts: of all headings, the chain in item order with the most items, then the latest places.

    The best chain that ends before each item rank is kept while headings are read from
    the front, so a document costs headings times items.  Without a heading there is none.
    """
    if not text:
        return []
    found = sorted((m.start(), k, number) for k, number, pattern in _HEADINGS for m in pattern.finditer(text))
    best: list[tuple[int, int, int]] = []  # chain length, sum of places, heading before
    by_rank: list[tuple[int, int, int] | None] = [None] * len(ITEMS)  # length, sum, heading: best chain that ends with the rank
    for i, (place, k, _) in enumerate(found):
        before = max((b for b in by_rank[:k] if b), key=lambda b: b[:2], default=(0, 0, -1))
        best.append((before[0] + 1, before[1] + place, before[2]))
        if by_rank[k] is None or by_rank[k][:2] < best[i][:2]:
            by_rank[k] = (*best[i][:2], i)
    if not found:
        return []
    chain, i = [], max(range(len(found)), key=lambda i: best[i][:2])
    while i != -1:
        chain.append(i)
        i = best[i][2]
    chain.reverse()
    ends = [found[i][0] for i in chain[1:]] + [len(text)]
    return [(found[i][2], text[found[i][0] : end].strip()) for i, end in zip(chain, ends, strict=True)]


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(page_text, na_action="ignore")


_SECTIONS = ArrayType(StructType([StructField("item", StringType()), StructField("text", StringType())]))


@F.pandas_udf(_SECTIONS)
def split_sections(text: pd.Series) -> pd.Series:
    """Items of a report; a text without any heading is one section, 0."""
    return text.map(lambda t: [{"item": i, "text": s} for i, s in (item_sections(t) or [("0", t or "")])])
