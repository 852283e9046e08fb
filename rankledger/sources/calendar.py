"""Calendar and detail pages: links, titles and attributes by an HTML parser, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, url

TITLES = ("h1", "h2", "title")


class _Page(HTMLParser):
    """Links (href, text), the text of the first element of each of TITLES, and the values of all attributes by name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, str]] = []
        self.titles: dict[str, str] = {}
        self.attributes: dict[str, list[str]] = {}
        self.href: str | None = None
        self.link: list[str] = []
        self.reading: dict[str, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for name, value in attrs:
            self.attributes.setdefault(name, []).append(value or "")
        self.handle_data(" ")
        if tag == "a":
            self._close_link()
            self.href = dict(attrs).get("href")
        elif tag in TITLES and tag not in self.titles:
            self.reading[tag] = []

    def handle_endtag(self, tag: str) -> None:
        self.handle_data(" ")
        if tag == "a":
            self._close_link()
        elif tag in self.reading:
            self.titles[tag] = _one_line(self.reading.pop(tag))

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.link.append(data)
        for parts in self.reading.values():
            parts.append(data)

    def _close_link(self) -> None:
        if self.href is not None and self.href.strip() and _one_line(self.link):
            self.links.append((self.href.strip(), _one_line(self.link)))
        self.href, self.link = None, []

    def title(self) -> str | None:
        return next((self.titles[t] for t in TITLES if self.titles.get(t)), None)


def _one_line(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _pages(pages: DataFrame, id_column: str, html: str, schema: str, rows) -> DataFrame:
    """One output row for each tuple that ``rows`` gives of a parsed page, its id in front."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, body in zip(b["id"], b["html"]):
                page = _Page()
                page.feed(body or "")
                page.close()
                out += [(key, *row) for row in rows(page)]
            yield pd.DataFrame(out, columns=[c.split()[0].strip("`") for c in columns])

    kind = dict(pages.dtypes)[id_column]
    columns = [f"id {kind}", *schema.split(", ")]
    return pages.select(F.col(id_column).alias("id"), F.col(html).alias("html")).mapInPandas(run, ", ".join(columns))


def anchors(pages: DataFrame, id_column: str, html: str) -> DataFrame:
    """(id, pos, href, title) of every link that has both, in page order."""
    return _pages(pages, id_column, html, "pos int, href string, title string", lambda p: [(i, *link) for i, link in enumerate(p.links)])


def calendar_entries(pages: DataFrame, id_column: str, html: str, host: str, param: str = "tourn_id", titles: DataFrame | None = None) -> DataFrame:
    """(id, tournament, href, title) of https links to ``host`` with a numeric parameter; a tournament's first link counts.

    titles (column ``title``): only entries whose title is one of these, compared as exact keys, come out, so that the
    pages behind the others are never fetched.
    """
    a = anchors(pages, id_column, html)
    href = F.when(F.col("href").startswith("/"), F.concat(F.lit(f"https://{host}"), "href")).otherwise(F.col("href"))
    a = a.withColumn("href", href).where(url.allowed_source(F.col("href"), F.array(F.lit(host)))).withColumn("tournament", url.digits_param(F.col("href"), param)).where("tournament IS NOT NULL")
    first = a.groupBy("id", "tournament").agg(F.min_by(F.struct("href", "title"), "pos").alias("x")).select("id", "tournament", "x.href", "x.title")
    if titles is None:
        return first
    known = titles.select(text.exact_key(F.col("title")).alias("_key")).distinct()
    return first.withColumn("_key", text.exact_key(F.col("title"))).join(known, "_key", "left_semi").drop("_key")


def details(pages: DataFrame, id_column: str, html: str, attributes: list[str]) -> DataFrame:
    """(id, title, one column an attribute, error) of detail pages.

    The title is the first h1, else the first h2, else the title element. An attribute may occur once:
    DUPLICATE_ATTRIBUTE; it may not hold < or >: UNSAFE_ATTRIBUTE; a page without a title has MISSING_TITLE.
    """

    def row(page: _Page) -> list[tuple]:
        values, errors = [], []
        for name in attributes:
            found = page.attributes.get(name.lower(), [])
            value = " ".join(found[0].split()) if len(found) == 1 else None
            values.append(value)
            errors.append("DUPLICATE_ATTRIBUTE" if len(found) > 1 else "UNSAFE_ATTRIBUTE" if value and ("<" in value or ">" in value) else None)
        title = page.title()
        errors.append(None if title else "MISSING_TITLE")
        return [(title, *values, next((e for e in errors if e), None))]

    columns = ", ".join(f"{a.replace('-', '_')} string" for a in attributes)
    return _pages(pages, id_column, html, f"title string, {columns}, error string", row)
