"""A paged HTTP source that reads one consistent snapshot."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LIMIT = 5000


class Moved(RuntimeError):
    """The snapshot changed again and again while it was read."""


def http(url: str, timeout: float = 30.0) -> tuple[int, dict]:
    """(status, body) of a JSON answer."""
    with urllib.request.urlopen(url, timeout=timeout) as r:
        raw = r.read()
        return r.status, json.loads(raw) if raw else {}


def read_all(url: str, fetch: Callable[[str], tuple[int, dict]] = http, limit: int = LIMIT, tries: int = 5, pause: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """The items of all pages of one snapshot, in order.

    A page holds ``items`` and ``as_of``, and may hold ``total`` and ``from_snapshot``. Pages are read until as many items as total have come, or
    without a total until a page is empty; a server may give shorter pages than asked for. Status 202 (not ready) is asked again, up to tries times. If
    as_of changes between two pages, reading starts over, up to tries times, unless the page says that it isn't from a snapshot; nothing is
    given before the snapshot is whole.
    """
    join = "&" if "?" in url else "?"
    for _ in range(tries):
        rows: list[dict] = []
        as_of = None
        while True:
            for again in range(tries):
                status, page = fetch(f"{url}{join}limit={limit}&offset={len(rows)}")
                if status != 202:
                    break
                pause(0.5 * 2**again)
            else:
                raise TimeoutError(f"{url} isn't ready")
            if as_of is not None and page.get("as_of") != as_of and page.get("from_snapshot", True):
                break
            as_of = page.get("as_of")
            rows += page["items"]
            if not page["items"] or len(rows) >= page.get("total", float("inf")):
                yield from rows
                return
    raise Moved(url)


class PagedSource(DataSource):
    """``spark.read.format("paged").schema(...).option("url", ...)``: one partition per url, separated by spaces."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, [f.name for f in schema.fields])


class _Reader(DataSourceReader):
    def __init__(self, options, names):
        self.urls, self.limit, self.names = options["url"].split(), int(options.get("limit", LIMIT)), names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in read_all(partition.value, limit=self.limit):
            yield tuple(row.get(n) for n in self.names)
