"""Paged REST services as Spark data sources, with the transport passed in. Every request is made once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..shared import run_dir, written

#: Gives the body for (first, last, filters), or raises.
Transport = Callable[[int, int, dict[str, str]], str]
YEARS, MONTHS = (2015, 2024), (1, 12)


class Service:
    """Requests for rows first to last; a body, or None if the page failed or says so."""

    def __init__(self, transport: Transport, service: str, size: int) -> None:
        self.transport, self.service, self.size = transport, service, size

    def body(self, first: int, last: int, filters: dict[str, str]) -> dict | None:
        try:
            got = json.loads(self.transport(first, last, filters)).get(self.service)
        except Exception:  # noqa: BLE001  a failed page ends a scan, whatever the reason
            return None
        return got if got and got.get("RESULT", {}).get("CODE", "INFO-000") == "INFO-000" else None

    def probe(self, filters: dict[str, str]) -> tuple[int | None, dict | None]:
        """The total that a first request for one row tells, None if it failed, and its body."""
        body = self.body(1, 1, filters)
        return (None if body is None else int(body.get("list_total_count", 0))), body

    def rows(self, first: int, last: int, filters: dict[str, str], probe: dict | None = None) -> list[str]:
        """The rows as JSON; a probe's own row isn't asked for again."""
        body = probe if probe is not None and (first, last) == (1, 1) else self.body(first, last, filters)
        return [json.dumps(r, ensure_ascii=False) for r in (body or {}).get("row") or []]


class PageRange(InputPartition):
    def __init__(self, page: int, first: int, last: int) -> None:
        self.page, self.first, self.last = page, first, last


class PagedReader(DataSourceReader):
    """Pages of ``page_size`` rows, counted from 1, a partition each; the total is asked for once, when the scan is planned."""

    def __init__(self, options: dict, transport: Transport, service: str) -> None:
        self.service = Service(transport, service, int(options.get("page_size", 1000)))
        self.filters = {k: options[k] for k in ("year", "month") if k in options}

    def partitions(self) -> list[PageRange]:
        total, size = self.service.probe(self.filters)[0] or 0, self.service.size
        return [PageRange(k, s, min(s + size - 1, total)) for k, s in enumerate(range(1, total + 1, size))] or [PageRange(-1, 0, 0)]

    def read(self, part: PageRange) -> Iterator[tuple]:
        if part.page < 0:
            return
        rows = self.service.rows(part.first, part.last, self.filters)
        if not rows:
            yield (part.page, True, None)
        for r in rows:
            yield (part.page, False, r)


class Month(InputPartition):
    def __init__(self, year: int, month: int) -> None:
        self.year, self.month = year, month


class MonthReader(DataSourceReader):
    """A partition for each month of the years and months that the options name.

    Its task asks for the month's total, then page after page until one fails, which ends that month alone.
    """

    def __init__(self, options: dict, transport: Transport, service: str) -> None:
        self.service = Service(transport, service, int(options.get("page_size", 10)))
        self.years = _listed(options.get("years"), YEARS)
        self.months = _listed(options.get("months"), MONTHS)

    def partitions(self) -> list[Month]:
        return [Month(y, m) for y in self.years for m in self.months] or [Month(0, 0)]

    def read(self, part: Month) -> Iterator[tuple]:
        if not part.year:
            return
        filters = {"year": str(part.year), "month": f"{part.month:02d}"}
        (total, probe), size = self.service.probe(filters), self.service.size
        if total is None:
            yield (part.year, part.month, -1, True, None)
            return
        for page, first in enumerate(range(1, total + 1, size)):
            rows = self.service.rows(first, min(first + size - 1, total), filters, probe)
            if not rows:
                yield (part.year, part.month, page, True, None)
                return
            for r in rows:
                yield (part.year, part.month, page, False, r)


class PushedMonthReader(MonthReader):
    """Months are chosen by comparisons of year and month with constants too; Spark asks for its setting to be on."""

    def pushFilters(self, filters) -> Iterator:
        keep = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}
        for f in filters:
            if type(f) in keep and f.attribute in (("year",), ("month",)):
                name = f"{f.attribute[0]}s"
                setattr(self, name, [x for x in getattr(self, name) if keep[type(f)](x, f.value)])
            yield f  # rows are checked again


def _listed(text: str | None, default: tuple[int, int]) -> list[int]:
    return [int(x) for x in text.split(",") if x] if text is not None else list(range(default[0], default[1] + 1))


def _source(named: str, kind: type[DataSourceReader], columns: str, transport: Transport, service: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return named

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return kind(self.options, transport, service)

    return Source


def paged_source(name: str, transport: Transport, service: str) -> type[DataSource]:
    """A data source class to register: page, failed, row (JSON)."""
    return _source(name, PagedReader, "page int, failed boolean, row string", transport, service)


def monthly_source(name: str, transport: Transport, service: str, pushdown: bool = False) -> type[DataSource]:
    """A data source class to register: year, month, page, failed, row (JSON).

    With ``pushdown``, which needs ``spark.sql.python.filterPushdown.enabled``, predicates on year and month choose the
    partitions; without it, the options do.
    """
    return _source(name, PushedMonthReader if pushdown else MonthReader, "year int, month int, page int, failed boolean, row string", transport, service)


def _parsed(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    parsed = F.from_json("row", ", ".join(f"`{f}` string" for f in fields))
    return rows.where("not failed").select(*keys, parsed.alias("r")).select(*keys, "r.*")


def read_pages(spark: SparkSession, source: str, fields: list[str], page_size: int = 1000, stop_at_failure: bool = True, year: str | None = None, month: str | None = None, keep: str | None = None) -> DataFrame:
    """Text columns of all rows. A failed or empty page ends the result there, or with ``stop_at_failure`` off only goes missing.

    To know where the first failure is, pages have to be seen twice: they are kept as a table in ``keep``, or below the
    shared folder, so that none is requested again.
    """
    asked = spark.read.format(source).option("page_size", page_size)
    for name, value in (("year", year), ("month", month)):
        asked = asked.option(name, value) if value is not None else asked
    pages = asked.load()
    if stop_at_failure:
        pages = written(pages, keep or run_dir(spark, "pages"))
        broken = pages.where("failed").agg(F.coalesce(F.min("page"), F.lit(2**31 - 1)).alias("first_failed"))
        pages = pages.join(F.broadcast(broken), F.col("page") < F.col("first_failed")).drop("first_failed")  # one row
    return _parsed(pages, ["page"], fields)


def read_months(spark: SparkSession, source: str, fields: list[str], years: Sequence[int] | None = None, months: Sequence[int] | None = None, page_size: int = 10) -> DataFrame:
    """year, month, page and text columns of all rows of all the months, in one scan; a month ends at its first failure."""
    asked = spark.read.format(source).option("page_size", page_size)
    for name, value in (("years", years), ("months", months)):
        asked = asked.option(name, ",".join(map(str, value))) if value is not None else asked
    return _parsed(asked.load(), ["year", "month", "page"], fields)
