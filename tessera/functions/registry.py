"""The tools as SQL functions: what register() adds to a session can be called from spark.sql()."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import ingest, memory, web
from tessera.session import ship


def page_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield pd.Series([web.text_of(x) for x in s], dtype=object)


def json_facts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield pd.Series([memory.facts(x) for x in s], dtype=object)


class SplitText:
    """chunk_no, chunk: the chunks of a text, as a table."""

    def eval(self, text: str):
        for i, chunk in enumerate(ingest.split_text(text)):
            yield i + 1, chunk


class PageLinks:
    """link_no, url: the kept links of a page, as a table."""

    def eval(self, html: str, url: str):
        for i, link in enumerate(web.annotated(html, url)[1]):
            yield i + 1, link


class SearchResults:
    """rank, title, url, content: the results of a page of results, as a table."""

    def eval(self, html: str):
        for i, r in enumerate(web.search_results(html, 10)):
            yield i + 1, r["title"], r["url"], r["content"]


FUNCTIONS = {"page_text": (page_text, "string"), "json_facts": (json_facts, "array<string>")}
TABLES = {
    "split_text": (SplitText, "chunk_no int, chunk string"),
    "page_links": (PageLinks, "link_no int, url string"),
    "search_results": (SearchResults, "rank int, title string, url string, content string"),
}


def register(spark: SparkSession) -> list[str]:
    """Adds all functions and table functions to a session; returns their names."""
    ship(spark)
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(name, F.pandas_udf(f, kind))
    for name, (handler, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema))
    return [*FUNCTIONS, *TABLES]
