"""Pages that are fetched, retried a bounded number of times, and skipped if they fail; a failure is told, not raised."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Numbers of results by page, as in an address with ``start=``.
STEP = 10


def attempt(fetch: Callable, asked, retries: int = 2, pause: float = 0.0) -> tuple[int, str | None, str | None]:
    """(attempts, error, body): the first body that comes without an exception."""
    for k in range(1, retries + 2):
        try:
            return k, None, fetch(asked)
        except Exception as e:  # noqa: BLE001  whatever it is, the page is tried again and then skipped
            error = f"{type(e).__name__}: {e}"
            if k <= retries:
                time.sleep(pause)
    return k, error, None


class Page(InputPartition):
    def __init__(self, page: int) -> None:
        self.page = page


class CrawlReader(DataSourceReader):
    """A partition a page; its task fetches the page that starts with result (page - 1) * 10 + 1."""

    def __init__(self, options: dict, fetch: Callable[[int], str]) -> None:
        self.fetch, self.pages = fetch, int(options.get("pages", 5))
        self.retries, self.pause = int(options.get("retries", 2)), float(options.get("pause", 0))

    def partitions(self) -> list[Page]:
        return [Page(k) for k in range(1, self.pages + 1)]

    def read(self, part: Page) -> Iterator[tuple]:
        yield (part.page, *attempt(self.fetch, (part.page - 1) * STEP + 1, self.retries, self.pause))


def crawl_source(named: str, fetch: Callable[[int], str]) -> type[DataSource]:
    """A data source class to register: page, attempts, error (null if it went well), html. Options: pages, retries, pause."""

    class Crawl(DataSource):
        @classmethod
        def name(cls) -> str:
            return named

        def schema(self) -> str:
            return "page int, attempts int, error string, html string"

        def reader(self, schema) -> CrawlReader:
            return CrawlReader(self.options, fetch)

    return Crawl


def crawl(spark: SparkSession, source: str, pages: int = 5, retries: int = 2, pause: float = 0.0) -> DataFrame:
    return spark.read.format(source).options(pages=pages, retries=retries, pause=pause).load()


def fetched(asked: DataFrame, fetch: Callable[[dict], str], retries: int = 2, pause: float = 0.0) -> DataFrame:
    """A table of what to fetch, a page for each row: its columns with attempts, error and html. ``fetch`` gets the row."""
    names = asked.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [attempt(fetch, dict(zip(names, row)), retries, pause) for row in b.itertuples(index=False, name=None)]
            yield b.assign(attempts=[g[0] for g in got], error=[g[1] for g in got], html=[g[2] for g in got])

    return asked.mapInPandas(run, f"{kinds}, attempts int, error string, html string")
