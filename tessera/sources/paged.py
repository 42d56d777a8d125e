"""Paged services as a data source: cursors are followed until a page says there is no more, a root a partition.

fetch is a function of (root, cursor) that gives {"items": [...], "has_more": bool, "page_token": str}; it runs on the executors. Items come out as JSON.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_PAGES = 100_000


def pages(fetch: Callable, root: str, most: int = MOST_PAGES) -> Iterator[tuple[int, list]]:
    """Number and items of each page of a root. A cursor that comes again ends the walk with an error, so that a broken service can't hold a task for ever."""
    cursor, seen = "", set()
    for number in range(most):
        page = fetch(root, cursor)
        yield number, page.get("items") or []
        cursor = page.get("page_token") or ""
        if not page.get("has_more") or not cursor:
            return
        if cursor in seen:
            raise ValueError(f"{root}: the cursor {cursor!r} came twice")
        seen.add(cursor)
    raise ValueError(f"{root}: more than {most} pages")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots, self.fetch = json.loads(options["roots"]), cloudpickle.loads(base64.b64decode(options["fetch"]))

    def partitions(self):
        return [InputPartition(r) for r in self.roots]

    def read(self, partition):
        for number, items in pages(self.fetch, partition.value):
            for place, item in enumerate(items):
                yield partition.value, number, place, json.dumps(item, ensure_ascii=False)


class PagedSource(DataSource):
    @classmethod
    def name(cls):
        return "tessera_paged"

    def schema(self):
        return "root string, page int, place int, item string"

    def reader(self, schema):
        return _Reader(self.options)


def read(spark: SparkSession, roots: list[str], fetch: Callable) -> DataFrame:
    """root, page, place and item of all pages of the roots."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("tessera_paged").option("roots", json.dumps(roots)).option("fetch", base64.b64encode(cloudpickle.dumps(fetch)).decode()).load()
