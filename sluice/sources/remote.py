"""Batch sources over HTTP: whole files with retries, and paginated category listings."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATTEMPTS, PAUSE_S = 3, 2.0


def fetch(url: str, get: Callable[[str], bytes] | None = None, pause: float = PAUSE_S) -> bytes | None:
    """The body, after up to three attempts with growing pauses; None if it can't be had, so one source that is down stops nothing."""
    get = get or (lambda u: urllib.request.urlopen(u, timeout=60).read())
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return get(url)
        except Exception:  # whatever a server or network does
            if attempt < ATTEMPTS:
                time.sleep(pause * attempt)
    return None


class _Url(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class _FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])

    def partitions(self):
        return [_Url(u) for u in self.urls]

    def read(self, partition: _Url) -> Iterator[tuple]:
        body = fetch(partition.url)
        if body is not None:
            for seq, line in enumerate(body.decode("utf-8", "replace").split("\n")):
                yield partition.url, seq, line


class RemoteLines(DataSource):
    """(url, seq, value): lines of the files in the option `urls` (a JSON list), a task each; unreachable ones have none."""

    @classmethod
    def name(cls) -> str:
        return "remote_lines"

    def schema(self) -> str:
        return "url string, seq long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options)


def pages(base: str, params: dict, get: Callable[[str], bytes] | None = None) -> Iterator[dict]:
    """Answers of a paginated listing: the token `continue` of one is asked for with the next, until there is none.

    A listing whose first page cannot be had is left out, like any source; one that breaks
    off later is an error, as what came would pass for the whole.
    """
    token: dict = {}
    while True:
        body = fetch(f"{base}?{urllib.parse.urlencode(params | token)}", get)
        if body is None:
            if token:
                raise OSError(f"{base}: the listing breaks off")
            return
        answer = json.loads(body)
        yield answer
        token = answer.get("continue") or {}
        if not token:
            return


class _CategoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.categories = options["base"], json.loads(options["categories"])

    def partitions(self):
        return [_Url(c) for c in self.categories]

    def read(self, partition: _Url) -> Iterator[tuple]:
        seq = 0
        params = {"action": "query", "list": "categorymembers", "cmtitle": partition.url, "cmlimit": "500", "format": "json"}
        for answer in pages(self.base, params):
            for m in answer.get("query", {}).get("categorymembers", []):
                yield partition.url, seq, m.get("title", "")
                seq += 1


class CategoryMembers(DataSource):
    """(category, seq, title) of the categories in the option `categories` (a JSON list) of the listing at `base`."""

    @classmethod
    def name(cls) -> str:
        return "category_members"

    def schema(self) -> str:
        return "category string, seq long, title string"

    def reader(self, schema) -> DataSourceReader:
        return _CategoryReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RemoteLines)
    spark.dataSource.register(CategoryMembers)
