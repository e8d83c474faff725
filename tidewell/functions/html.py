"""Paragraphs of web pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose text isn't content, and those that end a paragraph (fixed values).
SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}
BLOCKS = {"p", "div", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "td", "th", "tr", "ul", "ol", "pre", "blockquote"}


class _Paragraphs(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.held, self.out = 0, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in SKIPPED
        if tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.held.append(data)

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.out.append(text)


def paragraphs_of(html: str) -> list[str]:
    parser = _Paragraphs()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.out


def _paragraphs(html: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([[p for p in paragraphs_of(h or "") if len(p) >= n] for h, n in zip(html, least)])


def paragraphs(html: Column, least: Column) -> Column:
    """Paragraphs of at least so many characters, without navigation and scripts."""
    return F.pandas_udf(_paragraphs, "array<string>")(html, least)
