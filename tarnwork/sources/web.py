"""Web sources behind one ``fetch`` function: polite client, robots, collection pages, products."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.error import HTTPError, URLError
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from tarnwork.functions.html import read
from tarnwork.schemas import HTTP_RESPONSES

RETRIED = {429, 500, 502, 503, 504}  # fixed values


@dataclass
class Response:
    status: int
    content_type: str
    body: bytes


Fetch = Callable[[str], Response]


def with_retries(send: Fetch, url: str, max_retries: int, backoff: float, sleep: Callable[[float], None] = time.sleep) -> Response:
    """``send`` again on busy and failing servers, waiting longer each time; other answers stand at once."""
    for attempt in range(max_retries + 1):
        last = attempt == max_retries
        try:
            answer = send(url)
            if answer.status not in RETRIED or last:
                return answer
        except URLError:
            if last:
                raise
        sleep(backoff * (attempt + 1))
    raise AssertionError("unreachable")


class PoliteClient:
    """HTTP GET with a pause after each answer, retries and a bound on bytes."""

    def __init__(self, user_agent: str, delay: float = 1.0, timeout: float = 20.0, max_retries: int = 3, backoff: float = 1.0, clock=time.monotonic, sleep=time.sleep):
        self.agent, self.delay, self.timeout, self.max_retries, self.backoff = user_agent, delay, timeout, max_retries, backoff
        self.clock, self.sleep, self.last = clock, sleep, None

    def _send(self, url: str, max_bytes: int | None) -> Response:
        if self.last is not None and (rest := self.delay - (self.clock() - self.last)) > 0:
            self.sleep(rest)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as r:
                if max_bytes is not None and int(r.headers.get("Content-Length") or 0) > max_bytes:
                    raise RuntimeError("REJECTED_MAX_BYTES")
                body = r.read() if max_bytes is None else r.read(max_bytes + 1)
                if max_bytes is not None and len(body) > max_bytes:
                    raise RuntimeError("REJECTED_MAX_BYTES")
                return Response(r.status, r.headers.get("Content-Type", ""), body)
        except HTTPError as e:
            return Response(e.code, e.headers.get("Content-Type", ""), b"")
        finally:
            self.last = self.clock()

    def get(self, url: str, max_bytes: int | None = None) -> Response:
        return with_retries(lambda u: self._send(u, max_bytes), url, self.max_retries, self.backoff, self.sleep)


def fixture(rows: dict[str, tuple[int, str, bytes]]) -> Fetch:
    """A ``fetch`` over recorded answers; what is not recorded is 404."""
    return lambda url: Response(*rows.get(url, (404, "text/plain", b"")))


def robots(fetch: Fetch, base: str, agent: str) -> RobotFileParser:
    """The site's rules; without an answer of 200 nothing may be fetched."""
    answer = fetch(urljoin(base, "/robots.txt"))
    if answer.status != 200:
        raise RuntimeError(f"robots.txt: HTTP {answer.status}")
    rules = RobotFileParser()
    rules.parse(answer.body.decode("utf-8", "replace").splitlines())
    return rules


def check_robots(rules: RobotFileParser, agent: str, url: str, reason: str = "ROBOTS_BLOCKED") -> None:
    if not rules.can_fetch(agent, url):
        raise PermissionError(reason)


def product_links(html: str, base: str, domain: str = "amarket.com.bo") -> list[str]:
    """Canonical product addresses of this shop that a page links, sorted."""
    out = set()
    for href in read(html)["links"]:
        if "/products/" not in href:
            continue
        p = urlsplit(urljoin(base, href))
        if p.scheme == "https" and p.netloc.lower() == domain and "/products/" in p.path:
            out.add(f"https://{domain}{p.path.rstrip('/')}")
    return sorted(out)


def next_collection(html: str, page: str) -> str | None:
    """The linked page of this collection with the least number above the current one."""

    def number(url: str) -> int | None:
        found = [v for k, _, v in (q.partition("=") for q in urlsplit(url).query.split("&")) if k == "page" and v.isdigit()]
        return int(found[0]) if found else None

    here, now = urlsplit(page), number(page) or 1
    best: tuple[int, str] | None = None
    for href in read(html)["links"]:
        url = urljoin(page, href)
        p, n = urlsplit(url), number(url)
        if n is not None and n > now and p.scheme == "https" and p.netloc.lower() == here.netloc.lower() and p.path == here.path and (best is None or n < best[0]):
            best = (n, url)
    return best[1] if best else None


def discover(fetch: Fetch, collection: str, allowed: Callable[[str], bool] = lambda u: True) -> tuple[list[str], int]:
    """(sorted product addresses, pages read) of a paginated collection; a page met twice is an error."""
    seen, found, page = set(), set(), collection
    while page:
        if page in seen:
            raise RuntimeError("PAGINATION_LOOP_DETECTED")
        if not allowed(page):
            raise PermissionError("ROBOTS_COLLECTION_BLOCKED")
        seen.add(page)
        answer = fetch(page)
        if answer.status != 200:
            raise RuntimeError(f"COLLECTION_HTTP_{answer.status}")
        html = answer.body.decode("utf-8", "replace")
        found.update(product_links(html, page))
        page = next_collection(html, page)
    return sorted(found), len(seen)


def fetch_all(urls: DataFrame, fetch: Fetch, url_col: str = "url") -> DataFrame:
    """url, status, content_type, body of every address (the fetch function travels to the tasks)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [(u, fetch(u)) for u in batch[url_col]]
            yield pd.DataFrame([(u, a.status, a.content_type, a.body) for u, a in answers], columns=["url", "status", "content_type", "body"])

    return urls.select(url_col).mapInPandas(run, HTTP_RESPONSES)


class HttpDataSource(DataSource):
    """``spark.read.format("polite_http").option("urls", "a b c")``: one partition, so that pauses hold."""

    @classmethod
    def name(cls) -> str:
        return "polite_http"

    def schema(self) -> str:
        return HTTP_RESPONSES

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(self.options)


class _HttpReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def read(self, partition):
        client = PoliteClient(self.options.get("user_agent", "tarnwork"), float(self.options.get("delay", 1)))
        for url in self.options.get("urls", "").split():
            a = client.get(url)
            yield url, a.status, a.content_type, a.body


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpDataSource)
