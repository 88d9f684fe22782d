"""Paged sources: retries, throttling and adaptive page sizes around an injectable transport; a Python data source for pages on disk."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model.errors import ProviderAuthenticationError, ProviderAuthorizationError, ProviderError, RetriesExceededError


@dataclass
class Response:
    status: int
    body: object = None
    headers: dict | None = None


class TokenBucket:
    """At most ``capacity`` calls per ``period`` seconds."""

    def __init__(self, capacity: int, period: float = 1.0, clock=time.monotonic, sleep=time.sleep):
        self.capacity, self.period, self.clock, self.sleep = capacity, period, clock, sleep
        self.tokens, self.at = float(capacity), clock()

    def take(self) -> None:
        while True:
            now = self.clock()
            self.tokens = min(self.capacity, self.tokens + (now - self.at) * self.capacity / self.period)
            self.at = now
            if self.tokens >= 1:
                self.tokens -= 1
                return
            self.sleep((1 - self.tokens) * self.period / self.capacity)


def is_retryable(status: int) -> bool:
    return status >= 500 or status == 429


def should_throttle(limit: int, remaining: int, threshold: float) -> bool:
    """Whether the used share of a rate limit is above the threshold."""
    return limit > 0 and (limit - remaining) / limit > threshold


def error_of(status: int, url: str) -> ProviderError:
    kind = {401: ProviderAuthenticationError, 403: ProviderAuthorizationError}.get(status, ProviderError)
    return kind(f"{url}: status {status}", status=status)


def request(transport: Callable[[str], Response], url: str, *, attempts: int = 3, delay: float = 30.0, factor: float = 2.0, bucket: TokenBucket | None = None, sleep=time.sleep) -> Response:
    """One call with exponential backoff; other than retryable statuses raise at once."""
    for i in range(attempts):
        if bucket:
            bucket.take()
        r = transport(url)
        if r.status < 400:
            return r
        if not is_retryable(r.status):
            raise error_of(r.status, url)
        if i + 1 < attempts:
            sleep(delay * factor**i)
    raise RetriesExceededError(f"{url}: status {r.status} after {attempts} attempts")


def paginate(transport, url: str, data_path: str, next_url: Callable[[Response], str | None], **options) -> Iterator[dict]:
    """Rows of all pages. Status 204 ends the scan; a payload without an array under the path gives no rows."""
    while url:
        r = request(transport, url, **options)
        if r.status == 204:
            return
        rows = r.body
        for name in data_path.split(".") if data_path else []:
            rows = rows.get(name) if isinstance(rows, dict) else None
        if isinstance(rows, list):
            yield from rows
        url = next_url(r)


def download(fetch: Callable[[str | None, int], Response], page: int = 4000) -> Iterator[dict]:
    """Cursor-paged export. On status 422 the page is halved and the cursor kept; after a success it is full again."""
    cursor, size = None, page
    while True:
        r = fetch(cursor, size)
        if r.status == 422:
            if size == 1:
                raise error_of(422, "page of one row")
            size = max(1, size // 2)
            continue
        if r.status >= 400:
            raise error_of(r.status, "export")
        yield from r.body["items"]
        cursor, size = r.body.get("endCursor"), page
        if cursor is None:
            return


class PagesSource(DataSource):
    """``spark.read.format("pages").option("path", folder).option("starts", "a.json,b.json")``: chains of JSON pages, one partition per chain.

    A page is ``{"items": [...], "next": name}``; ``items`` and ``next`` can be named by options. Rows are (chain, item): the start of the chain and
    the item as JSON text. Pages are read through :func:`paginate`, from a folder that all executors can open (a URI of file, hdfs or s3).
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "chain string, item string"

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(self.options["path"], self.options["starts"].split(","), self.options.get("items", "items"), self.options.get("next", "next"))


class _PagesReader(DataSourceReader):
    def __init__(self, path: str, starts: list[str], items: str, following: str):
        self.path, self.starts, self.items, self.following = path.rstrip("/"), starts, items, following

    def partitions(self):
        return [InputPartition(s) for s in self.starts]

    def read(self, partition):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)

        def transport(name: str) -> Response:
            try:
                with store.open_input_file(f"{root}/{name}") as f:
                    return Response(200, json.loads(f.read()))
            except FileNotFoundError:
                return Response(404)

        for item in paginate(transport, partition.value, self.items, lambda r: r.body.get(self.following)):
            yield partition.value, json.dumps(item, ensure_ascii=False)
