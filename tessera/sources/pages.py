"""Pages: links with their surroundings, titles and sections; answers with their sources."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text isn't read.
_UNREAD = frozenset(("script", "style", "noscript", "template", "svg"))
_PARTING = frozenset("p div section article header footer nav aside ul ol li table tr td th h1 h2 h3 h4 h5 h6 br main form blockquote pre dl dt dd figure body html title".split())
_HEADS = frozenset(("h1", "h2", "h3", "h4"))


class _Reader(HTMLParser):
    """Lines of text with the element they stand in, links with the line around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.unread = 0
        self.line: list[str] = []
        self.lines: list[tuple[str, str]] = []
        self.links: list[list] = []
        self.waiting: list[list] = []
        self.inside = "body"

    def _end_line(self) -> None:
        text = " ".join("".join(self.line).split())
        for link in self.waiting:
            link[1] = text
        self.waiting, self.line = [], []
        if text:
            self.lines.append((self.inside, text))

    def handle_starttag(self, tag, attrs):
        if tag in _UNREAD:
            self.unread += 1
        if tag in _PARTING:
            self._end_line()
            self.inside = tag
        if tag == "a":
            if href := dict(attrs).get("href"):
                self.links.append([href, ""])
                self.waiting.append(self.links[-1])

    def handle_endtag(self, tag):
        if tag in _UNREAD and self.unread:
            self.unread -= 1
        if tag in _PARTING:
            self._end_line()
            self.inside = "body"

    def handle_data(self, data):
        if not self.unread:
            self.line.append(data)


def _read(html: str | None) -> _Reader:
    r = _Reader()
    r.feed(html or "")
    r.close()
    r._end_line()
    return r


def links(pages: DataFrame) -> DataFrame:
    """page_id, place, href and around (the line it stands in) of the first link to each address of a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, html in zip(pdf.page_id, pdf.html, strict=True):
                seen = {}
                for href, around in _read(html).links:
                    seen.setdefault(href, around)
                rows += [(page, k, h, a) for k, (h, a) in enumerate(seen.items())]
            yield pd.DataFrame(rows, columns=["page_id", "place", "href", "around"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, place int, href string, around string")


def sections(pages: DataFrame) -> DataFrame:
    """page_id, title, body (lines; headings marked, list items dashed, repeats of the line before dropped) and n_lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, html in zip(pdf.page_id, pdf.html, strict=True):
                lines = _read(html).lines
                title = next((t for tag, t in lines if tag == "title"), next((t for tag, t in lines if tag in _HEADS), None))
                body = [("## " if tag in _HEADS else "- " if tag == "li" else "") + t for tag, t in lines if tag != "title"]
                body = [b for k, b in enumerate(body) if k == 0 or body[k - 1] != b]
                rows.append((page, title, "\n".join(body), len(body)))
            yield pd.DataFrame(rows, columns=["page_id", "title", "body", "n_lines"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, body string, n_lines int")


def split_answer(df: DataFrame, column: str) -> DataFrame:
    """Adds answer and sources (label, scope, score): the text before the last line ``Sources:``, and the lines after it."""
    block = F.regexp_extract(column, r"(?s)\nSources:\s*\n(.*)$", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\[\d+\] "))
    one = lambda x: F.struct(
        F.trim(F.regexp_extract(x, r"^\[\d+\] ([^|]*)", 1)).alias("label"),
        F.nullif(F.trim(F.regexp_extract(x, r"^[^|]*\|([^|]*)", 1)), F.lit("")).alias("scope"),
        F.regexp_extract(x, r"([0-9.]+)\s*$", 1).try_cast("double").alias("score"),
    )
    return df.withColumn("answer", F.trim(F.regexp_replace(column, r"(?s)\nSources:\s*\n.*$", ""))).withColumn("sources", F.transform(lines, one))
