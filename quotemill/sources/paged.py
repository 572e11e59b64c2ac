"""Paged feeds as a data source: a partition for each page in batch, page numbers as offsets in a stream.

    register(spark)
    spark.read.format("paged_feed").option("url", "https://host/odds?page={page}").load()

The driver asks for the first page only, which says how many there are; every other page is fetched where its
partition runs, with retries, and is fetched again if that executor is lost. Rows are captures as the parsers of
``feeds`` take them, with the page's number and whether the announced pages are all within ``most``.

A stream goes on after the last page of its checkpoint: pages are numbered for good, new ones are added at the end.
A page that can't be read fails the task, and with it the batch: a listing with a hole isn't a listing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..workers import importable
from .landing import fetch

NAME, SCHEMA = "paged_feed", "payload string, observed_at timestamp, page int, pages int, complete boolean"


@dataclass
class Page(InputPartition):
    first: int
    last: int
    total: int
    complete: bool


@dataclass(frozen=True)
class Feed:
    """``url`` with ``{page}``; pages from ``first`` on; at most ``most``; ``total``: where a page says how many there are,
    names with dots between; ``each``: pages a partition; options ``header.<name>`` are sent along."""

    url: str
    first: int
    most: int
    total: str
    each: int
    headers: dict[str, str]

    @classmethod
    def of(cls, options) -> Feed:
        # option names come in lower case
        url = options.get("url", "")
        if "{page}" not in url:
            raise ValueError("paged_feed wants an option url with {page} in it")
        headers = {k[len("header.") :]: v for k, v in options.items() if k.lower().startswith("header.")}
        out = cls(url, int(options.get("first", 1)), int(options.get("most", 50)), options.get("total", "paging.total"), int(options.get("each", 1)), headers)
        if out.most < 1 or out.each < 1:
            raise ValueError("most and each are at least 1")
        return out

    def get(self, page: int) -> str:
        return fetch(self.url.replace("{page}", str(page)), self.headers).decode("utf-8")

    def announced(self) -> int:
        """How many pages the first one says there are; 1 if it doesn't say."""
        at = json.loads(self.get(self.first))
        for name in self.total.split("."):
            at = at.get(name) if isinstance(at, dict) else None
        return max(1, int(at or 1))

    def partitions(self, begin: int, end: int, total: int, complete: bool) -> list[Page]:
        """Pages ``begin`` up to before ``end``, both counted from 0."""
        return [Page(i, min(i + self.each, end), total, complete) for i in range(begin, end, self.each)]

    def read(self, part: Page):
        for i in range(part.first, part.last):
            body = self.get(self.first + i)
            yield body, datetime.now(UTC), self.first + i, part.total, part.complete


class PagedReader(DataSourceReader):
    def __init__(self, feed: Feed):
        self.feed = feed

    def partitions(self):
        total = self.feed.announced()
        return self.feed.partitions(0, min(total, self.feed.most), total, total <= self.feed.most)

    def read(self, partition):
        return self.feed.read(partition)


class PagedStream(DataSourceStreamReader):
    """Offsets count pages. Each trigger asks the first page anew; ``most`` doesn't apply, nothing is left out."""

    def __init__(self, feed: Feed):
        self.feed = feed

    def initialOffset(self):
        return {"pages": 0}

    def latestOffset(self):
        return {"pages": self.feed.announced()}

    def partitions(self, start, end):
        return self.feed.partitions(start["pages"], end["pages"], end["pages"], True)

    def read(self, partition):
        return self.feed.read(partition)


class PagedFeed(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PagedReader(Feed.of(self.options))

    def streamReader(self, schema):
        return PagedStream(Feed.of(self.options))


def register(spark: SparkSession) -> None:
    importable()
    spark.dataSource.register(PagedFeed)
