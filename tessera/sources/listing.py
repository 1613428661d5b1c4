"""A paginated listing as a Spark data source: each page names the cursor of the next.

Pages are JSON objects ``{"items": [...], "after": cursor or null}``; ``read_page`` gets a cursor (null
for the first page) and returns one.  The default reads ``<folder>/<cursor or 'first'>.json``.  A batch
read follows cursors from the start.  A stream's offset is the last page read and how many of its items: that page
is read again, as it may have grown or got a successor since.  A batch of a stream reads at most ``pages`` pages (an option, 100).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def read_page(folder: str, cursor: str | None) -> dict | None:
    try:
        with open(f"{folder}/{cursor or 'first'}.json") as f:
            return json.load(f)
    except FileNotFoundError:
        return None


def follow(folder: str, cursor: str | None) -> Iterator[tuple[str, dict]]:
    """Pages from a cursor on, with the cursor that each was read by."""
    while (page := read_page(folder, cursor)) is not None:
        yield cursor or "first", page
        cursor = page.get("after")
        if not cursor:
            return


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for cursor, page in follow(self.folder, None):
            for item in page["items"]:
                yield cursor, json.dumps(item)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, pages: int):
        self.folder, self.pages = folder, pages

    def initialOffset(self) -> dict:
        return {"cursor": "", "seen": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start
        for count, (cursor, page) in enumerate(follow(self.folder, start["cursor"] or None)):
            if count >= self.pages:
                break
            seen = start["seen"] if count == 0 else 0
            rows += [(cursor, json.dumps(item)) for item in page["items"][seen:]]
            at = {"cursor": "" if cursor == "first" else cursor, "seen": max(seen, len(page["items"]))}
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        seen = start["seen"]
        for cursor, page in follow(self.folder, start["cursor"] or None):
            last = cursor == (end["cursor"] or "first")
            for item in page["items"][seen : end["seen"] if last else None]:
                yield cursor, json.dumps(item)
            if last:
                return
            seen = 0


class ListingSource(DataSource):
    """``spark.read.format("listing").load(folder)``: ``cursor, item`` with items as JSON."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "cursor string, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("pages", "100")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)
