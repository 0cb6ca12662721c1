"""Paged listings as a data source: a partition a page, whole listings only, as a batch and as a stream."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ledgerloom.sources.landing import LISTED

FIELDS = tuple(f.split()[0] for f in LISTED.split(", "))
SCHEMA = f"listing string, page_no int, {LISTED}"
PAGE = re.compile(r"(\d+)\.json$")


@dataclass
class Page(InputPartition):
    path: str
    listing: str
    number: int
    run: int
    """How many pages, from 1 without a gap, have landed of the listing."""


def _landed(path: str) -> dict[str, dict[int, str]]:
    """Names only: the pages of each listing (a folder under path), whose number ends the file's name."""
    files, base = fs.FileSystem.from_uri(path)
    out: dict[str, dict[int, str]] = {}
    for info in files.get_file_info(fs.FileSelector(base, recursive=True)):
        found = PAGE.search(info.base_name)
        if found and info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
            out.setdefault(info.path[len(base) : -len(info.base_name)].strip("/"), {})[int(found[1])] = info.path
    return out


def _run(pages: dict[int, str]) -> int:
    n = 0
    while n + 1 in pages:
        n += 1
    return n


def _answer(path: str, name: str) -> dict:
    with fs.FileSystem.from_uri(path)[0].open_input_stream(name) as held:
        return json.loads(held.read())


def _pages(landed: dict[str, dict[int, str]]) -> list[Page]:
    return [Page(name, listing, number, _run(pages)) for listing, pages in sorted(landed.items()) for number, name in sorted(pages.items())]


def _rows(path: str, page: Page) -> Iterator[tuple]:
    """The rows of a page. It fails if its status is bad, or if it speaks of more pages than have landed without a gap."""
    answer = _answer(path, page.path)
    if answer.get("status") == "013":
        return
    if answer.get("status") != "000":
        raise ValueError(f"status {answer.get('status')} in {page.path}")
    if (answer.get("total_page") or 1) > page.run:
        raise ValueError(f"listing {page.listing!r} lacks page {page.run + 1} of {answer['total_page']}")
    for row in answer.get("list") or []:
        yield (page.listing, page.number, *(None if row.get(f) is None else str(row[f]) for f in FIELDS))


class PagedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Page]:
        return _pages(_landed(self.path))

    def read(self, partition: Page | None) -> Iterator[tuple]:
        return _rows(self.path, partition) if isinstance(partition, Page) else iter(())


class PagedStream(DataSourceStreamReader):
    """Listings in the order of their names (dates, say); an offset is the last one that was handed on.

    A listing that is not whole yet holds back itself and those behind it, so none is lost or read in part. A listing
    that lands later under a lesser name than the offset is not seen.
    """

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        last = getattr(self, "last", "")
        for listing, pages in sorted((k, v) for k, v in _landed(self.path).items() if k > last):
            if 1 not in pages or (_answer(self.path, pages[1]).get("total_page") or 1) > _run(pages):
                break
            last = listing
        self.last = last
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return _pages({k: v for k, v in _landed(self.path).items() if start["listing"] < k <= end["listing"]})

    def read(self, partition: Page) -> Iterator[tuple]:
        return _rows(self.path, partition)


class PagedListing(DataSource):
    """Format `paged_listing`: <path>/<listing>/<anything><page number>.json; path is a URI or an absolute path."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options["path"].rstrip("/"))

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(self.options["path"].rstrip("/"))


def paged_listing(spark: SparkSession, path: str) -> DataFrame:
    """listing, page_no and the filings' columns of all landed listings; a missing page fails the read."""
    spark.dataSource.register(PagedListing)
    return spark.read.format("paged_listing").option("path", path).load()


def paged_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of whole listings."""
    spark.dataSource.register(PagedListing)
    return spark.readStream.format("paged_listing").option("path", path).load()
