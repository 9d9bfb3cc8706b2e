"""Mail as a streaming source: a data source whose offsets are the checkpoint.

    spark.dataSource.register(MailSource)
    spark.readStream.format("pressmill_mail").option("client", "package.module:make").option("query", "from:x")

``make()``, or ``make(options)`` with what the stream was given, gives a client with ``list(query, max_results, label_ids, include_spam) ->
ids`` and ``get(id) -> message``.  An offset is the date of the newest message so far,
in milliseconds, and the ids that have just this date: the service searches by whole
seconds, so a search overlaps the last one, and what the offset tells apart is what
is new.  Ids and dates pass the driver, messages are fetched by tasks, and a batch that
is run again asks for the same range.

A message without a date is never new.  One that arrives late, with a date before the
offset, isn't seen: neither does a search after a checkpoint.
"""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .mail import incremental_query, message_row

SCHEMA = "message_id string, sender string, internal_date string, payload string, seq long"
#: Ids that one task fetches.
PER_TASK = 50


def client_of(options: dict):
    """What ``package.module:function`` makes, of the options if it takes an argument."""
    module, _, function = options["client"].partition(":")
    make = getattr(importlib.import_module(module), function)
    return make(options) if inspect.signature(make).parameters else make()


class Range(InputPartition):
    """Some ids of a batch, with their places in it."""

    def __init__(self, rows: list[tuple[int, str]]):
        super().__init__(rows)
        self.rows = rows


def dated(client, options: dict, after_ms: int) -> list[tuple[int, str]]:
    """(date, id) of what a search finds from the second of ``after_ms`` on, oldest first."""
    labels = [x for x in options.get("labels", "").split(",") if x]
    spam = options.get("includespam", "false").strip().lower() in ("1", "true", "yes", "on")
    ids = client.list(incremental_query(options.get("query", ""), after_ms), int(options.get("maxresults", "500")), labels, spam)
    date = client.date if hasattr(client, "date") else lambda key: client.get(key).get("internalDate")
    found = [(str(date(key) or ""), key) for key in ids]
    return sorted((int(d), key) for d, key in set(found) if d.isdigit())


def between(found: list[tuple[int, str]], start: dict, end: dict | None = None) -> list[tuple[int, str]]:
    """Those after one offset and up to another."""
    new = [(d, k) for d, k in found if d > start["ms"] or (d == start["ms"] and k not in start["ids"])]
    return new if end is None else [(d, k) for d, k in new if d < end["ms"] or (d == end["ms"] and k in end["ids"])]


def fetch(options: dict, partition: Range) -> Iterator[tuple]:
    from email.utils import parseaddr

    client = client_of(options)
    for seq, key in partition.rows:
        key, sender, date, payload = message_row(client.get(key), key)
        yield key, parseaddr(sender)[1] or sender, date, payload, seq


def ranges(found: list[tuple[int, str]]) -> list[Range]:
    rows = [(seq, key) for seq, (_, key) in enumerate(found)]
    return [Range(rows[k : k + PER_TASK]) for k in range(0, len(rows), PER_TASK)]


class MailReader(DataSourceReader):
    """All that a search finds after ``after_ms``."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Range]:
        start = {"ms": int(self.options.get("afterms", "-1")), "ids": []}
        return ranges(between(dated(client_of(self.options), self.options, max(0, start["ms"])), start))

    def read(self, partition: Range) -> Iterator[tuple]:
        return fetch(self.options, partition)


class MailStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.start = options, {"ms": -1, "ids": []}

    def initialOffset(self) -> dict:
        return {"ms": int(self.options.get("afterms", "-1")), "ids": []}

    def latestOffset(self) -> dict:
        if self.start["ms"] < 0:
            self.start = self.initialOffset()
        new = between(dated(client_of(self.options), self.options, max(0, self.start["ms"])), self.start)
        if not new:
            return self.start
        top = new[-1][0]
        before = self.start["ids"] if top == self.start["ms"] else []
        return {"ms": top, "ids": sorted({*before, *(k for d, k in new if d == top)})}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.start = end
        return ranges(between(dated(client_of(self.options), self.options, max(0, start["ms"])), start, end))

    def read(self, partition: Range) -> Iterator[tuple]:
        return fetch(self.options, partition)

    def commit(self, end: dict) -> None:
        """Offsets are kept by the query; the service keeps nothing."""


class MailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pressmill_mail"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict:
        return {k.lower().replace("_", ""): v for k, v in self.options.items()}

    def reader(self, schema) -> MailReader:
        return MailReader(self._options())

    def streamReader(self, schema) -> MailStreamReader:
        return MailStreamReader(self._options())
