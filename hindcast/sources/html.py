"""Rows of HTML lists and tables as a table function over a column of raw pages."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf


class _Items(HTMLParser):
    """Links of list items, and cells of table rows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str]] = []
        self._item, self._href, self._text = False, None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "tr"):
            self._item, self._href, self._text = True, None, []
        elif self._item and tag == "a" and self._href is None:
            self._href = dict(attrs).get("href") or ""

    def handle_data(self, data):
        if self._item:
            self._text.append(data)

    def handle_endtag(self, tag):
        if tag in ("li", "tr") and self._item:
            self.rows.append((self._href or "", " ".join("".join(self._text).split())))
            self._item = False


@udtf(returnType="item int, href string, label string")
class HtmlItems:
    """One output row a list item or table row of a page; none for a null page."""

    def eval(self, html: str):
        if html is None:
            return
        parser = _Items()
        parser.feed(html)
        for i, (href, label) in enumerate(parser.rows):
            yield i, href, label


def html_items(spark: SparkSession, pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, item, href, label) of every page, by a lateral join with the table function."""
    spark.udtf.register("html_items", HtmlItems)
    pages.createOrReplaceTempView("_pages_with_items")
    return spark.sql(f"SELECT p.`{key}`, t.item, t.href, t.label FROM _pages_with_items p, LATERAL html_items(p.`{html}`) t")
