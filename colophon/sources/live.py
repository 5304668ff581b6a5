"""Optional live connector: a Python data source that fetches URLs, for clusters with network access.

Every URL must pass the link policy before it is fetched; retries follow the retry policy. Nothing in the library or its
tests depends on it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.urls import API_HOSTS, METADATA_HOSTS

RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def allowed(url: str) -> bool:
    p = urlsplit(url)
    host = (p.hostname or "").rstrip(".").lower()
    return p.scheme == "https" and not p.username and not p.password and p.port in (None, 443, 80) and host in API_HOSTS and host not in METADATA_HOSTS


def wait_ms(attempt: int, base_ms: int, most_ms: int, retry_after_ms: float | None = None) -> int:
    return int(min(retry_after_ms, most_ms)) if retry_after_ms and retry_after_ms > 0 else int(min(base_ms * 2 ** max(0, attempt), most_ms))


def fetch(url: str, opener: Callable | None = None, retries: int = 2, base_ms: int = 500, most_ms: int = 8000, timeout: float = 15.0, sleep=time.sleep) -> tuple[str | None, str | None]:
    """(body, error); a missing record is an empty body without an error."""
    from urllib.error import HTTPError, URLError
    from urllib.request import Request, urlopen

    if not allowed(url):
        return None, "blocked"
    open_ = opener or (lambda r: urlopen(r, timeout=timeout))
    for attempt in range(retries + 1):
        try:
            with open_(Request(url, headers={"accept": "application/json, application/xml"})) as r:
                return r.read().decode("utf-8", "replace"), None
        except HTTPError as e:
            if e.code in (404, 410):
                return "", None
            if e.code not in RETRYABLE or attempt == retries:
                return None, f"http {e.code}"
            after = e.headers.get("Retry-After") if e.headers else None
            sleep(wait_ms(attempt, base_ms, most_ms, float(after) * 1000 if after and after.replace(".", "", 1).isdigit() else None) / 1000)
        except (URLError, TimeoutError) as e:
            if attempt == retries:
                return None, f"network {e}"
            sleep(wait_ms(attempt, base_ms, most_ms) / 1000)
    return None, "network"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.width = max(1, int(options.get("partitions", "1")))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls[k :: self.width]) for k in range(min(self.width, max(1, len(self.urls))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.value:
            body, error = fetch(url)
            yield url, body, error


class ScholarlyApi(DataSource):
    """spark.dataSource.register(ScholarlyApi); spark.read.format("scholarly_api").option("urls", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "scholarly_api"

    def schema(self) -> str:
        return "url string, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
