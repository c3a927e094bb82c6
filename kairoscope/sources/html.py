"""Raw pages to markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without readable text, and those that end a line.
HIDDEN = {"script", "style", "noscript", "template", "head"}
BLOCKS = {"p", "div", "section", "article", "br", "ul", "ol", "table", "tr", "nav", "header", "footer", "main", "blockquote"}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.href: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag in BLOCKS:
            self.out.append("\n\n" if tag != "br" else "\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "a":
            self.href = dict(attrs).get("href")
            self.out.append("[" if self.href else "")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in BLOCKS - {"br"}:
            self.out.append("\n\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href})")
            self.href = None

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def normalised(content: Column, kind: Column) -> Column:
    """Markdown and plain text as they are, pages as markdown; anything else raises."""

    @F.pandas_udf("string")
    def convert(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(to_markdown)

    return F.when(kind.isin("markdown", "text"), content).when(kind == "html", convert(content)).otherwise(F.raise_error(F.concat(F.lit("unsupported format: "), kind)))
