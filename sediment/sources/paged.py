"""A paged index as a data source: a partition for each of a few pages or for each run of many, a pass as an option, and a stream that goes on where it ended.

    spark.dataSource.register(PagedIndex)
    spark.read.format("paged_index").option("url", "https://host/index?start={offset}").option("size", 10).load()

url: where the page that begins with position {offset} is, in pass {pass}: http, https, or a path (a * takes the first file that fits) that the executors see, too.
size: positions on a page. pass: its number (1). again: true reads the first and the last page once more after the others. pages: how many a
micro-batch of a stream takes at most. A page that can't be read is a row with an error and no positions, and so is a fault to landing.page_faults.
"""

from __future__ import annotations

import glob
import json
import sys
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

# the executors' Python needn't have this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "pass int, page int, again boolean, total long, sortBy string, positions array<struct<id:string,name:string>>, error string"
TRIES, WAIT, TIMEOUT = 3, 0.5, 30


@dataclass
class Page(InputPartition):
    """One page; in a stream a partition of its own."""

    offset: int
    again: bool = False


#: Pages that one task reads, one after the other; an index of FEW pages at most has a task for each, as they are read side by side.
PER_TASK, FEW = 64, 8


@dataclass
class Run(InputPartition):
    """Pages that follow each other, in one partition: a task costs more than a page."""

    pages: tuple[Page, ...]


def fetched(url: str) -> dict:
    """The JSON document there; some tries, and more time between them."""
    for attempt in range(TRIES):
        try:
            if url.startswith(("http://", "https://")):
                with urllib.request.urlopen(url, timeout=TIMEOUT) as found:
                    return json.loads(found.read())
            path = url.removeprefix("file://")
            if "*" in path:
                path = min(glob.glob(path), default=path)
            with open(path, encoding="utf-8") as file:
                return json.loads(file.read())
        except FileNotFoundError:
            raise
        except OSError:
            if attempt == TRIES - 1:
                raise
            time.sleep(WAIT * 2**attempt)
    raise AssertionError


class _Pages:
    """What the reader and the stream have in common."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.url, self.size, self.number = options["url"], int(options.get("size", 10)), int(options.get("pass", 1))
        self.again = options.get("again", "false").lower() == "true"
        self.most = int(options.get("pages", 100))
        self.fields = [f.name for f in schema["positions"].dataType.elementType]

    def get(self, offset: int) -> dict:
        return fetched(self.url.replace("{offset}", str(offset)).replace("{pass}", str(self.number)))

    def total(self) -> int:
        try:
            return max(0, int(self.get(0).get("total") or 0))
        except (OSError, ValueError):
            return 0

    def read(self, partition: Page) -> Iterator[tuple]:
        page, error, found = partition.offset // self.size, None, {}
        try:
            found = self.get(partition.offset)
            rows = [None if x is None else tuple(None if x.get(f) is None else str(x[f]) for f in self.fields) for x in found["positions"]] if found.get("positions") is not None else None
            yield self.number, page, partition.again, found.get("total"), found.get("sortBy"), rows, None
            return
        except (OSError, ValueError, TypeError, AttributeError, KeyError) as x:  # a broken document, or none
            error = f"{type(x).__name__}: {x}"[:500]
        yield self.number, page, partition.again, None, None, None, error


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[Run]:
        offsets = list(range(0, max(self.total(), 1), self.size))
        step = PER_TASK if len(offsets) > FEW else 1
        runs = [Run(tuple(map(Page, offsets[k : k + step]))) for k in range(0, len(offsets), step)]
        return [*runs, *(Run((Page(o, True),)) for o in sorted({offsets[0], offsets[-1]}) if self.again)]

    def read(self, partition: Run) -> Iterator[tuple]:
        for page in partition.pages:
            yield from super().read(page)


class _Stream(_Pages, DataSourceStreamReader):
    """Offsets are positions. A page that isn't full yet is left for later."""

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        if not hasattr(self, "seen"):
            self.seen = 0
        whole = self.total() // self.size * self.size
        self.seen = max(self.seen, min(whole, self.seen + self.most * self.size))
        return {"position": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.seen = max(getattr(self, "seen", 0), end["position"])
        return [Page(o) for o in range(start["position"], end["position"], self.size)]

    def commit(self, end: dict) -> None:
        """Nothing is kept for pages that were read."""


class PagedIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(self.options, schema)
