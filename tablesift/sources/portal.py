"""Package pages of an open-data portal as a Spark data source, a page for each partition."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def pages(first: int, last: int, size: int, count: int | None = None) -> list[tuple[int, int]]:
    """(start, rows) of each page of the range, which ends at the portal's count."""
    last = min(last, count) if count is not None else last
    return [(a, min(size, last - a)) for a in range(max(0, first), last, size)]


def range_name(tag: str, first: int, last: int) -> str:
    return f"{tag}_from{first}_to{last}"


def fetch(url: str, timeout: float = 60) -> dict:
    with urllib.request.urlopen(url, timeout=timeout) as reply:
        return json.load(reply)


class Page(InputPartition):
    def __init__(self, start: int, rows: int):
        super().__init__(start)
        self.start, self.rows = start, rows


class PortalReader(DataSourceReader):
    def __init__(self, options: dict, get: Callable[[str], dict] = fetch):
        self.url, self.get = options["url"].rstrip("/"), get
        self.first, self.last, self.size = int(options.get("from", 0)), int(options.get("to", 1 << 31)), int(options.get("page", 10))

    def partitions(self) -> list[InputPartition]:
        count = self.get(f"{self.url}/package_search?rows=0")["result"]["count"]
        return [Page(*p) for p in pages(self.first, self.last, self.size, count)]

    def read(self, partition: Page) -> Iterator[tuple]:
        found = self.get(f"{self.url}/package_search?start={partition.start}&rows={partition.rows}")
        for package in found["result"]["results"]:
            yield package.get("id"), json.dumps(package)


class Span(InputPartition):
    """Packages changed from `first` to `last`, times as the portal writes them; without `skip` (of the first time), and of the last time `only`."""

    def __init__(self, first: str, last: str, skip: list[str], only: list[str] | None):
        super().__init__((first, last))
        self.first, self.last, self.skip, self.only = first, last, skip, only


class PortalStream(DataSourceStreamReader):
    """Packages in the order in which they were changed. An offset is the time of the last change that was read, and the ids that had it:
    each package comes once for each of its changes, however often polls are repeated, and also where several share a time. A batch is
    divided at times into parts of about a page, which tasks read; what was changed again meanwhile comes in a later batch."""

    def __init__(self, options: dict, get: Callable[[str], dict] = fetch):
        self.url, self.get, self.size = options["url"].rstrip("/"), get, int(options.get("page", 10))

    def _changes(self, first: str, last: str, fields: str = "") -> Iterator[dict]:
        query = {"fq": f"metadata_modified:[{first or '*'} TO {last or '*'}]", "sort": "metadata_modified asc, id asc", "rows": str(max(self.size, 100) if fields else self.size), **({"fl": fields} if fields else {})}
        at = 0
        while True:
            found = self.get(f"{self.url}/package_search?{urllib.parse.urlencode({**query, 'start': str(at)})}")["result"]["results"]
            yield from found
            at += len(found)
            if not found:
                return

    def initialOffset(self) -> dict:
        return {"time": "", "ids": []}

    def latestOffset(self) -> dict:
        newest = self.get(f"{self.url}/package_search?{urllib.parse.urlencode({'sort': 'metadata_modified desc, id desc', 'rows': '1', 'start': '0'})}")["result"]["results"]
        if not newest:
            return self.initialOffset()
        time = newest[0]["metadata_modified"]
        return {"time": time, "ids": sorted(x["id"] for x in self._changes(time, time, "id,metadata_modified"))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start == end or not end["time"]:
            return []
        times = [x["metadata_modified"] for x in self._changes(start["time"], end["time"], "id,metadata_modified")]
        cuts = sorted({start["time"] or (times[0] if times else end["time"]), *times[self.size :: self.size], end["time"]})
        spans = [(a, b) for a, b in zip(cuts, cuts[1:])] or [(cuts[0], cuts[0])]
        # a span has its first time only where it is the first span
        return [Span(a, b, start["ids"] if i == 0 and a == start["time"] else [] if i == 0 else ["*"], end["ids"] if b == end["time"] else None) for i, (a, b) in enumerate(spans)]

    def read(self, partition: Span) -> Iterator[tuple]:
        for package in self._changes(partition.first, partition.last):
            time, name = package["metadata_modified"], package["id"]
            if time == partition.first and (name in partition.skip or partition.skip == ["*"]):
                continue
            if time == partition.last and partition.only is not None and name not in partition.only:
                continue
            yield name, json.dumps(package)


class PortalSource(DataSource):
    """`spark.dataSource.register(PortalSource)`; then format `portal` with url, from, to and page gives (id, package JSON), all at once or, as a
    stream, what was changed since the last batch."""

    @classmethod
    def name(cls) -> str:
        return "portal"

    def schema(self) -> str:
        return "id string, package string"

    def reader(self, schema) -> PortalReader:
        return PortalReader(self.options)

    def streamReader(self, schema) -> PortalStream:
        return PortalStream(self.options)
