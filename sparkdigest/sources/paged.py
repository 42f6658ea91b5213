"""A paged service as a data source, for batches and streams: pages name the one after them and are asked for one at a time.

A scan has a partition for each chain of pages (a mailbox, a calendar, a feed); a task follows its chain only as far as rows are
wanted. Filters on columns go to the service. Where it keeps an index of what its pages hold, pages and whole chains that can't
match are never opened. With a limit all chains are read in turn by one task, which stops at the last row.

Offline, pages are JSON files, {"items": [...], "next": name or null}: those in the folder itself begin a chain, further ones lie in
folders below it; index.json may say, for each page, {"least": {column: value}, "most": {...}, "next": ...}. A live reader
overrides client().
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from typing import Any, Protocol

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import DataType, DateType, StructType, TimestampNTZType, TimestampType

_TESTS = {
    ds.EqualTo: lambda x, y: x == y,
    ds.GreaterThan: lambda x, y: x > y,
    ds.GreaterThanOrEqual: lambda x, y: x >= y,
    ds.LessThan: lambda x, y: x < y,
    ds.LessThanOrEqual: lambda x, y: x <= y,
    ds.In: lambda x, y: x in y,
}


@dataclass
class Wanted:
    """What a scan asks a service for: columns, and filters (column, kind, value) that all have to hold."""

    schema: StructType
    filters: list[tuple[str, type, Any]] = field(default_factory=list)

    def take(self, f: ds.Filter) -> bool:
        """Whether the service can check this filter."""
        known = type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.schema.names
        if known:
            value = f.value
            if isinstance(f, ds.In):
                value = [_typed(x, self.schema[f.attribute[0]].dataType) for x in value]
            else:
                value = _typed(value, self.schema[f.attribute[0]].dataType)
            self.filters.append((f.attribute[0], type(f), value))
        return known

    def row(self, item: dict[str, Any]) -> tuple | None:
        """The columns of an item, or None if a filter doesn't hold; a column that it lacks is null."""
        values = {c.name: _typed(item.get(c.name), c.dataType) for c in self.schema}
        if all(values[c] is not None and _TESTS[kind](values[c], y) for c, kind, y in self.filters):
            return tuple(values.values())
        return None

    def may_hold(self, entry: dict[str, Any]) -> bool:
        """Whether a page can hold a row, by its least and greatest values."""
        for c, kind, y in self.filters:
            kept = self.schema[c].dataType
            low, high = (_typed(entry.get(k, {}).get(c), kept) for k in ("least", "most"))
            if low is None or high is None:
                continue
            reach = {ds.GreaterThan: high, ds.GreaterThanOrEqual: high, ds.LessThan: low, ds.LessThanOrEqual: low}.get(kind)
            fits = any(low <= x <= high for x in (y if kind is ds.In else [y])) if reach is None else _TESTS[kind](reach, y)
            if not fits:
                return False
        return True


def _typed(value: Any, kind: DataType) -> Any:
    """A JSON value as Spark wants it for a column; instants without a zone are in UTC."""
    if value is None:
        return None
    if isinstance(kind, TimestampType | TimestampNTZType):
        at = datetime.fromisoformat(value) if isinstance(value, str) else value
        at = at if at.tzinfo else at.replace(tzinfo=UTC)
        return at if isinstance(kind, TimestampType) else at.astimezone(UTC).replace(tzinfo=None)
    if isinstance(kind, DateType) and isinstance(value, str):
        return date.fromisoformat(value)
    return value


class PageClient(Protocol):
    """What a reader needs from a service."""

    def chains(self) -> list[str]: ...

    def page(self, token: str, wanted: Wanted) -> tuple[list[dict[str, Any]], str | None]: ...

    def index(self) -> dict[str, dict[str, Any]]: ...


class FolderClient:
    """Pages in the files of a folder. The folder must be one that driver and executors see."""

    def __init__(self, folder: str):
        self.folder = folder

    def chains(self) -> list[str]:
        return sorted(x for x in os.listdir(self.folder) if x.endswith(".json") and x != "index.json")

    def page(self, token: str, wanted: Wanted) -> tuple[list[dict[str, Any]], str | None]:
        with open(os.path.join(self.folder, token), encoding="utf-8") as f:
            page = json.load(f)
        return page.get("items") or [], page.get("next")

    def index(self) -> dict[str, dict[str, Any]]:
        try:
            with open(os.path.join(self.folder, "index.json"), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {}


def followed(client: PageClient, token: str | None, wanted: Wanted, index: dict[str, dict[str, Any]]) -> Iterator[tuple]:
    """Rows of a chain from a page on; the next page is asked for when the rows before it are taken."""
    while token:
        entry = index.get(token)
        if entry is not None and "next" in entry and not wanted.may_hold(entry):
            token = entry["next"]
            continue
        items, token = client.page(token, wanted)
        yield from (row for x in items if (row := wanted.row(x)) is not None)


def reaches(token: str | None, wanted: Wanted, index: dict[str, dict[str, Any]]) -> bool:
    """Whether any page of a chain has to be opened."""
    while token:
        entry = index.get(token)
        if entry is None or "next" not in entry or wanted.may_hold(entry):
            return True
        token = entry["next"]
    return False


@dataclass
class Chains(ds.InputPartition):
    """Chains that a task reads in turn."""

    roots: list[str]


class PagedReader(ds.DataSourceReader):
    def __init__(self, client: PageClient, schema: StructType, pages: int | None = None, limit: int | None = None):
        self.client, self.wanted, self.pages, self.limit = client, Wanted(schema), pages, limit

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[ds.InputPartition]:
        if self.limit is not None and self.limit <= 0:
            return []
        index = self.client.index()
        roots = self.client.chains()
        roots = roots if self.pages is None else roots[: max(0, self.pages)]
        roots = [r for r in roots if reaches(r, self.wanted, index)]
        return [Chains(roots)] if roots and self.limit is not None else [Chains([r]) for r in roots]

    def read(self, partition: Chains | None) -> Iterator[tuple]:
        # a scan without partitions still has a task, which gets None
        left, index = self.limit, self.client.index()
        for root in partition.roots if partition else []:
            for row in followed(self.client, root, self.wanted, index):
                yield row
                if left is not None:
                    left -= 1
                    if not left:
                        return


@dataclass
class Pages(ds.InputPartition):
    """Pages of one chain that a micro-batch reads."""

    tokens: list[str]


class PagedStream(ds.DataSourceStreamReader):
    """New pages of each chain. The offset is the number of pages by chain; pages stay as they are once they name a next one or
    are listed, and a new one is what the last one names later."""

    def __init__(self, client: PageClient, schema: StructType):
        self.client, self.wanted = client, Wanted(schema)
        self.known: dict[str, list[str]] = {}

    def _walked(self, root: str) -> list[str]:
        """Tokens of a chain as far as it goes now; only the last one known is asked again."""
        tokens = self.known.setdefault(root, [root])
        while (after := self.client.page(tokens[-1], self.wanted)[1]) is not None:
            tokens.append(after)
        return tokens

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {root: len(self._walked(root)) for root in self.client.chains()}

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        new = {root: self._walked(root)[start.get(root, 0) : n] for root, n in end.items()}
        return [Pages(tokens) for tokens in new.values() if tokens]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for token in partition.tokens:
            items, _ = self.client.page(token, self.wanted)
            yield from (row for x in items if (row := self.wanted.row(x)) is not None)

    def commit(self, end: dict) -> None:
        """Nothing to clean up: the service keeps its pages."""


class PagedSource(ds.DataSource):
    """spark.read.format("paged").schema(...).option("path", folder)[.option("limit", rows)][.option("pages", chains)]"""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def client(self) -> PageClient:
        return FolderClient(self.options["path"])

    def _number(self, name: str) -> int | None:
        return int(self.options[name]) if self.options.get(name) else None

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return PagedReader(self.client(), schema, self._number("pages"), self._number("limit"))

    def streamReader(self, schema: StructType) -> ds.DataSourceStreamReader:
        return PagedStream(self.client(), schema)


def register(spark: SparkSession, source: type[PagedSource] = PagedSource) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
