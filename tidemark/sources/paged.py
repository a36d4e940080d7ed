"""Sources that come in pages: stored pages chained by cursors, and a data source (batch and stream) with pages as partitions.

Stored pages are followed by pointer doubling: after k joins every feed knows its first 2 ** k pages, so a chain of the
longest allowed length takes eight joins and not one step a page. A chain that goes on past the cap, as one with a broken
cursor does for ever, fails its feed; none of its rows are taken.

The data source asks a client for numbered pages. In batch every page is a partition; in a stream the number of the next
page is the offset, so a query that starts again reads what it hasn't committed, and a replay of a batch reads the same pages.

Defined results: a feed without a stored first page has no pages; two stored pages of one cursor are one (the greatest by
content); a page without rows counts as a page; null cursors end a chain; an empty table gives no rows.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Fixed value: pages that one report may have.
MAX_PAGES = 200


def follow(pages: DataFrame, starts: DataFrame, cap: int = MAX_PAGES) -> DataFrame:
    """feed, number (from 1), cursor, failure of the pages that each feed's chain reaches: pages: cursor, next (null: the last);
    starts: feed, cursor. failure is pagination_failure on all pages of a feed that goes on past the cap."""
    jump = pages.groupBy("cursor").agg(F.max("next").alias("next"))
    known = starts.select("feed", "cursor", F.lit(1).alias("number")).join(jump.select("cursor"), "cursor", "left_semi")
    reach = 1
    # One page more than allowed is looked for, to tell a chain of just the cap from a longer one.
    while reach < cap + 1:
        further = known.join(jump.filter("next IS NOT NULL"), "cursor").select("feed", F.col("next").alias("cursor"), (F.col("number") + reach).alias("number"))
        known = known.select("feed", "cursor", "number").unionByName(further.join(pages.select("cursor").distinct(), "cursor", "left_semi").select("feed", "cursor", "number"))
        onward = jump.select(F.col("cursor").alias("next"), F.col("next").alias("beyond"))
        jump = jump.join(onward, "next", "left").select("cursor", F.col("beyond").alias("next"))
        reach *= 2
    longest = known.groupBy("feed").agg(F.max("number").alias("longest"))
    held = known.filter(F.col("number") <= cap).join(longest, "feed")
    return held.select("feed", "number", "cursor", F.when(F.col("longest") > cap, "pagination_failure").alias("failure"))


class Client(Protocol):
    """What the data source asks: how many pages there are, and the rows of one (from 0)."""

    def count(self) -> int: ...

    def page(self, number: int) -> list[dict[str, Any]]: ...


class FolderClient:
    """Pages as JSON documents ({"data": [...]}) in a folder that all executors see, in order of name."""

    def __init__(self, options: dict[str, str]) -> None:
        self.store, self.root = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])

    def _names(self) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.path.endswith(".json"))

    def count(self) -> int:
        return len(self._names())

    def page(self, number: int) -> list[dict[str, Any]]:
        with self.store.open_input_stream(self._names()[number]) as held:
            return json.loads(held.read()).get("data") or []


@dataclass
class Page(InputPartition):
    number: int


class _Pages:
    """One page is one partition: executors ask for their own pages, the driver only for their number."""

    def __init__(self, options: dict[str, str], schema) -> None:
        self.options, self.schema, self.cap = dict(options), schema, int(options.get("maxpages", MAX_PAGES))

    def client(self) -> Client:
        module, name = self.options.get("client", f"{__name__}:FolderClient").split(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def numbered(self, first: int, end: int) -> list[Page]:
        if end - first > self.cap:
            raise ValueError(f"pagination_failure: {end - first} pages, {self.cap} allowed")
        return [Page(n) for n in range(first, end)]

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no page
            return
        rows, names = self.client().page(partition.number), self.schema.fieldNames()
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        yield pa.record_batch([pa.array([text(r.get(n)) for r in rows], pa.string()) for n in names], names)


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return self.numbered(0, self.client().count())


class _StreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.client().count()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.numbered(start["page"], end["page"])

    def commit(self, end: dict) -> None:
        """Nothing to keep: the offset is in the query's checkpoint."""


class PagedSource(DataSource):
    """spark.read.format("paged") after spark.dataSource.register(PagedSource). Options: path, client (module:Class), maxPages.

    The schema is given by the reader; all its columns are strings, nested values come as JSON.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options, schema)
