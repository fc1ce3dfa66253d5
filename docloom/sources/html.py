"""Links of HTML pages, and a crawl over pages that a fetch function gives."""

from __future__ import annotations

import time
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import resolve_url

#: Link texts that lead to the next page.
NEXT_TEXTS = (">", "»", "Вперед", "Next", "Следующая")


def links(pages: DataFrame, suffix: str = "", key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, pos, link`` of anchors whose address ends with ``suffix``: absolute, in order, each address once."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    each = pages.select(key, url, F.posexplode(found).alias("pos", "href"))
    if suffix:
        each = each.where(F.col("href").endswith(suffix))
    return each.select(key, "pos", resolve_url(F.col(url), F.col("href")).alias("link")).groupBy(key, "link").agg(F.min("pos").alias("pos"))


class _Next(HTMLParser):
    """The address after the current page in the pagination, and that of the first anchor with a text for "next"."""

    def __init__(self) -> None:
        super().__init__()
        self.depth = 0  # inside of the pagination
        self.current = self.after = False
        self.href: str | None = None
        self.by_pagination: str | None = None
        self.by_text: str | None = None
        self.text = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        classes = (given.get("class") or "").split()
        if self.depth and tag not in ("br", "img", "input", "hr"):
            self.depth += 1
        elif not self.depth and "pagination" in classes:
            self.depth = 1
        if self.depth and tag == "span" and "current" in classes:
            self.current = True
        if tag == "a" and given.get("href") is not None:
            if self.after and self.by_pagination is None:
                self.by_pagination = given["href"]
            self.href, self.text = given["href"], ""

    def handle_endtag(self, tag: str) -> None:
        if tag == "span" and self.current:
            self.current, self.after = False, True
        if self.depth:
            self.depth -= 1
            self.after = self.after and self.depth > 0
        if tag == "a" and self.href is not None:
            if self.by_text is None and self.text.strip() in NEXT_TEXTS:
                self.by_text = self.href
            self.href = None

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.text += data


def next_address(html: str | None) -> str | None:
    parser = _Next()
    parser.feed(html or "")
    return parser.by_pagination or parser.by_text


@F.pandas_udf(T.StringType())
def _next(html: pd.Series) -> pd.Series:
    return html.map(next_address)


def next_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, next_url``: the page after each page by its pagination, else by a link's text; null if none."""
    return pages.select(key, url, _next(F.col(html)).alias("n")).select(key, resolve_url(F.col(url), F.col("n")).alias("next_url"))


def not_present(found: DataFrame, files: DataFrame) -> DataFrame:
    """Links whose file name (the last piece of the path) is not among ``files.name``."""
    name = F.element_at(F.split("link", "/"), -1)
    return found.withColumn("name", name).join(files.select("name"), "name", "left_anti")


def crawl(start: str, fetch: Callable[[str], str], max_pages: int = 50, delay: float = 0.5) -> list[tuple[str, str]]:
    """(address, html) from page to next page, until one repeats, leads to itself, or enough have been read."""
    from urllib.parse import urljoin

    seen: dict[str, str] = {}
    at: str | None = start
    while at and at not in seen and len(seen) < max_pages:
        seen[at] = fetch(at)
        link = next_address(seen[at])
        at = urljoin(at, link) if link else None
        if at and delay:
            time.sleep(delay)
    return list(seen.items())
