"""A Python data source over a paged service, to read, to follow as a stream and to write.

Reading: pages are partitions, filters go to the service, and a page that keeps failing is an error or a
row that says so. Following: offsets are numbers of rows, so a stream goes on from its checkpoint.
Writing: rows go in bulk under keys, so a repeated call or task adds nothing, and a write that falls
short takes back what it added.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

#: The column that takes the message of a page that couldn't be read.
ERROR = "_error"


class Page(InputPartition):
    def __init__(self, start: int, size: int):
        super().__init__(start)
        self.start, self.size = start, size


def _get(url: str, attempts: int, **asked: object):
    """(rows, rows in all if the service says so) of a request, tried again after a pause that doubles."""
    for left in reversed(range(attempts)):
        try:
            with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(asked)}", timeout=60) as reply:
                return json.load(reply)["result"], reply.headers.get("X-Total-Count")
        except (OSError, ValueError, KeyError):
            if not left:
                raise
            time.sleep(0.1 * 2 ** (attempts - left))


def count(url: str, query: str = "", attempts: int = 4) -> int:
    """How many rows the service has for a query, by its own count: no row is read."""
    total = _get(url, attempts, sysparm_offset=0, sysparm_limit=1, sysparm_fields="sys_id", sysparm_query=query)[1]
    if total is None:
        raise ValueError("the service doesn't say how many rows it has; give the option total")
    return int(total)


class PagedReader(DataSourceReader):
    """Options: url, total (else the service is asked), page, attempts, query, start (rows before it were read by an earlier run).

    A page that fails every attempt ends the read, unless the schema has a column _error: then it is one
    row of nulls with the page's first row and the message there, so that it can be counted and read anew.
    """

    def __init__(self, options, fields: list[str]):
        self.url, self.fields = options["url"], fields
        self.size, self.begin = int(options.get("page", "1000")), int(options.get("start", "0"))
        self.attempts, self.total = int(options.get("attempts", "4")), options.get("total")
        self.query, self.pushed = options.get("query", ""), []

    def _query(self) -> str:
        return "^".join([q for q in (self.query, *self.pushed) if q])

    def partitions(self):
        total = int(self.total) if self.total is not None and not self.pushed else count(self.url, self._query(), self.attempts)
        return [Page(a, min(self.size, total - a)) for a in range(self.begin, total, self.size)]

    def read(self, partition: Page):
        own = [f for f in self.fields if f != ERROR]
        try:
            rows, _ = _get(self.url, self.attempts, sysparm_offset=partition.start, sysparm_limit=partition.size, sysparm_fields=",".join(own), sysparm_query=self._query())
        except (OSError, ValueError, KeyError) as wrong:
            if ERROR not in self.fields:
                raise
            yield tuple(f"{partition.start}: {wrong}" if f == ERROR else None for f in self.fields)
            return
        for row in rows:
            yield tuple(None if f == ERROR or row.get(f) in (None, "") else str(row[f]) for f in self.fields)


class FilteredReader(PagedReader):
    """PagedReader whose filters go to the service."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the interface's name
        """Equality and membership of plain values go to the service; the others stay with Spark."""
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            plain = values is not None and len(f.attribute) == 1 and f.attribute[0] != ERROR and all(isinstance(v, str) and v and not set(v) & set(",^") for v in values)
            if plain:
                self.pushed.append(f"{f.attribute[0]}IN{','.join(sorted(values))}")
            else:
                yield f


class Followed(DataSourceStreamReader):
    """PagedReader's options but total. An offset is how many rows the service has; those between two are read by pages.

    Rows must keep their places and be added at the end. Spark keeps the offsets in the stream's checkpoint:
    rows read by a batch that wasn't committed are read again, by the same pages, and no other ones are.
    """

    def __init__(self, options, fields: list[str]):
        self.pages = PagedReader(options, fields)

    def initialOffset(self) -> dict:  # noqa: N802  the interface's names
        return {"rows": self.pages.begin}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"rows": max(self.pages.begin, count(self.pages.url, self.pages.query, self.pages.attempts))}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(a, min(self.pages.size, end["rows"] - a)) for a in range(start["rows"], end["rows"], self.pages.size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.read(partition)

    def commit(self, end: dict) -> None:
        """The service keeps nothing for a reader."""


@dataclass
class Written(WriterCommitMessage):
    """What a task sent, and what the service says it has of that."""

    sent: int
    taken: int


class BulkWriter(DataSourceWriter):
    """Options: url, key (a column that names each row), page, attempts, run (what marks the rows of this write).

    Each page is one call, {"key": ..., "run": ..., "records": [...]}, to which the service answers how many of the keys it
    now has, as {"taken": n}. It puts a row in the place of one with its key, so calls and tasks may be
    repeated. If it has fewer in the end than were sent, the write is an error; a write that fails takes
    back its rows by its run.
    """

    def __init__(self, options, fields: list[str]):
        self.url, self.key, self.fields = options["url"], options["key"], fields
        self.size, self.attempts = int(options.get("page", "1000")), int(options.get("attempts", "4"))
        self.run = options.get("run") or uuid.uuid4().hex
        if self.key not in fields:
            raise ValueError(f"the rows have no column {self.key}, which is to be their key")

    def _call(self, method: str, told: dict) -> dict:
        asked = urllib.request.Request(self.url, json.dumps(told, default=str).encode(), {"Content-Type": "application/json"}, method=method)
        for left in reversed(range(self.attempts)):
            try:
                with urllib.request.urlopen(asked, timeout=60) as reply:
                    return json.load(reply)
            except (OSError, ValueError):
                if not left:
                    raise
                time.sleep(0.1 * 2 ** (self.attempts - left))
        raise ValueError("attempts must be 1 at least")

    def write(self, iterator: Iterator[Row]) -> Written:
        sent = taken = 0
        for page in batched(iterator, self.size):
            records = {str(r[self.key]): dict(zip(self.fields, r)) for r in page}
            sent += len(records)
            taken += self._call("POST", {"key": self.key, "run": self.run, "records": list(records.values())})["taken"]
        return Written(sent, taken)

    def commit(self, messages: list[Written | None]) -> None:
        sent, taken = (sum(getattr(m, c) for m in messages if m) for c in ("sent", "taken"))
        if taken < sent:
            self.abort(messages)
            raise ValueError(f"{sent - taken} of {sent} rows were not written")

    def abort(self, messages: list[Written | None]) -> None:
        self._call("DELETE", {"run": self.run})


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").schema("a string, ...").option("url", ...).load()

    With the option pushdown, filters go to the service; spark.sql.python.filterPushdown.enabled must then be true.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "number string, short_description string"

    def reader(self, schema) -> PagedReader:
        kind = FilteredReader if self.options.get("pushdown", "false") == "true" else PagedReader
        return kind(self.options, schema.fieldNames())

    def streamReader(self, schema) -> Followed:  # noqa: N802
        return Followed(self.options, schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> BulkWriter:
        if overwrite:
            raise ValueError("the service's rows are added to or replaced by key: write with mode append")
        return BulkWriter(self.options, schema.fieldNames())
