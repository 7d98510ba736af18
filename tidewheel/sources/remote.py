"""A log behind an API as a data source that plans: filters travel to the server, and its answer is read in ranges side by side."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: What the API can filter by equality.
EQUAL = ("model_name", "event_type", "model_hash")
TRIES = 4


def ask(url: str, params: dict[str, str], headers: dict[str, str]) -> dict:
    """The JSON that an URL answers. A server that is down or overloaded for a moment is asked again, a few times."""
    asked = urllib.request.Request(f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(params)}", headers=headers)
    for left in reversed(range(TRIES)):
        try:
            with urllib.request.urlopen(asked, timeout=30) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as failed:
            if not left or failed.code < 500 and failed.code != 429:
                raise
        except OSError:
            if not left:
                raise
        time.sleep(0.2 * 2 ** (TRIES - left))
    raise AssertionError


class Range(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class RemoteLog(DataSource):
    """spark.read.format("remote_log"): events of a paged API, newest first. Options: url; page (rows of a request, 1,000 by
    default), pages (requests of a partition, 10 by default), headers (a JSON object).

    The server takes model_name, model_hash, event_type (equal), since and until (inclusive), limit and offset, and answers with
    {"total": n, "events": [{...}]}. Rows appended between the count and the reads shift the ranges of an API that
    lists the newest first; bound `timestamp` above for a stable answer.
    """

    @classmethod
    def name(cls) -> str:
        return "remote_log"

    def schema(self) -> str:
        return "snapshot_hash string, model_hash string, model_name string, timestamp timestamp, event_type string, actor string, source string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return RemoteLogReader(self.options)


class RemoteLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.headers = options["url"], json.loads(options.get("headers", "{}"))
        self.page, self.pages = int(options.get("page", 1000)), int(options.get("pages", 10))
        self.params: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what the server can do; yields what Spark must still do. Open bounds go to the server as closed ones, and
        are checked again; a second bound or value for what is asked already stays with Spark."""
        for f in filters:
            column, value = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, getattr(f, "value", None)
            key = None
            if isinstance(f, EqualTo) and column in EQUAL and isinstance(value, str):
                key = column
            elif column == "timestamp" and isinstance(value, datetime):
                key = "since" if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else "until" if isinstance(f, (LessThan, LessThanOrEqual)) else None
                value = (value if value.tzinfo else value.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat()
            if key is None or key in self.params:
                yield f
                continue
            self.params[key] = value
            if isinstance(f, (GreaterThan, LessThan)):
                yield f

    def partitions(self) -> list[InputPartition]:
        total = ask(self.url, {**self.params, "limit": "1", "offset": "0"}, self.headers)["total"]
        size = self.page * self.pages
        return [Range(at, min(size, total - at)) for at in range(0, total, size)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        at, end = partition.offset, partition.offset + partition.limit
        while at < end:
            events = ask(self.url, {**self.params, "limit": str(min(self.page, end - at)), "offset": str(at)}, self.headers)["events"]
            if not events:
                return
            for e in events:
                when = datetime.fromisoformat(e["timestamp"].replace("Z", "+00:00"))
                payload = e.get("payload")
                payload = payload if isinstance(payload, str) or payload is None else json.dumps(payload)
                yield (e.get("snapshot_hash"), e.get("model_hash"), e.get("model_name"), when if when.tzinfo else when.replace(tzinfo=timezone.utc), e["event_type"], e.get("actor", "unknown"), e.get("source"), payload)
            at += len(events)


def remote_log(spark: SparkSession, url: str, **options: object) -> DataFrame:
    """The events of a remote log; filters on it are sent along."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RemoteLog)
    return spark.read.format("remote_log").options(url=url, **{k: str(v) for k, v in options.items()}).load()
