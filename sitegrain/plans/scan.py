"""Scans: requests with redirects, retries and body limits; plans; steps; scans of another host's pages."""

from __future__ import annotations

import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, functions as F

from ..functions.urls import map_origin, normalize
from .crawl import RequestGate, retry_delay

#: Statuses that are tried again, and statuses that redirect.
AGAIN, MOVED = (429, 500, 502, 503, 504), (301, 302, 303, 307, 308)


class RequestFailure(Exception):
    """A response that cannot be used; never tried again."""

    def __init__(self, message: str, status: int | None = None, url: str | None = None, chain: list | None = None) -> None:
        super().__init__(message)
        self.status, self.url, self.chain = status, url, chain or []


@dataclass
class Response:
    url: str
    status: int
    headers: dict[str, str]
    body: bytes
    chain: list[dict] = field(default_factory=list)


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def open_url(url: str, timeout: float, agent: str):
    """(status, headers with lower-case names, stream) of one request, redirects not followed."""
    request = urllib.request.Request(url, headers={"User-Agent": agent})
    try:
        got = urllib.request.build_opener(_Stay).open(request, timeout=timeout)
    except urllib.error.HTTPError as e:
        got = e
    return got.status, {k.lower(): v for k, v in got.headers.items()}, got


def retry_after(value: str | None, now: datetime | None = None) -> float | None:
    """Milliseconds that a Retry-After header (seconds or a date) asks for, 0 to 30,000; None without one."""
    if not value:
        return None
    if re.fullmatch(r"\s*\d+(\.\d+)?\s*", value):
        return min(float(value) * 1000, 30_000.0)
    try:
        at = parsedate_to_datetime(value)
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return min(max(0.0, (at - (now or datetime.now(UTC))).total_seconds() * 1000), 30_000.0)


def _attempts(url, opener, gate, timeout, agent, retries, sleep, jitter):
    for attempt in range(retries + 1):
        gate.wait()
        try:
            status, headers, stream = opener(url, timeout, agent)
        except OSError:
            if attempt == retries:
                raise
            sleep(retry_delay(attempt, None, jitter()) / 1000)
            continue
        if status not in AGAIN or attempt == retries:
            return status, headers, stream
        stream.close()
        asked = retry_after(headers.get("retry-after"))
        sleep(retry_delay(attempt, None if asked is None else asked / 1000, jitter()) / 1000)


def fetch(url: str, gate: RequestGate, config: dict, agent: str = "sitegrain", retries: int = 2, opener=open_url, sleep=time.sleep, jitter=lambda: random.random() * 100) -> Response:
    """A page by way of its redirects. A loop, too many hops or too long a body is a RequestFailure."""
    seen, chain, limit = {url}, [], config["maxResponseBytes"]
    while True:
        status, headers, stream = _attempts(url, opener, gate, config["timeout"] / 1000, agent, retries, sleep, jitter)
        try:
            if status not in MOVED or "location" not in headers:
                body = stream.read(limit + 1)
                if len(body) > limit:
                    raise RequestFailure(f"response exceeds {limit} bytes", status, url, chain)
                return Response(url, status, headers, body, chain)
        finally:
            stream.close()
        target = urljoin(url, headers["location"])
        chain.append({"url": url, "status": status, "location": target})
        if target in seen:
            raise RequestFailure("redirect loop detected", status, url, chain)
        if len(chain) > config["maxRedirects"]:
            raise RequestFailure(f"more than {config['maxRedirects']} redirects", status, url, chain)
        seen.add(target)
        url = target


PAGE = "snapshot_id string, url string, final_url string, status int, content_type string, x_robots string, error string, html string, redirect_chain array<struct<url:string,status:int,location:string>>, response_bytes long"


def page_row(site: str, url: str, gate: RequestGate, config: dict, **how) -> dict:
    """A request's outcome as a row; html only of HTML responses, failures as ``error``."""
    row = dict.fromkeys(x.split()[0] for x in PAGE.split(", ")) | {"snapshot_id": site, "url": url, "redirect_chain": [], "response_bytes": 0}
    try:
        got = fetch(url, gate, config, **how)
    except RequestFailure as e:
        return row | {"status": e.status, "final_url": e.url, "error": str(e), "redirect_chain": e.chain}
    except OSError as e:
        return row | {"error": str(e) or type(e).__name__}
    kind = got.headers.get("content-type", "")
    page = "text/html" in kind.lower() or "application/xhtml+xml" in kind.lower()
    return row | {"final_url": got.url, "status": got.status, "content_type": kind or None, "x_robots": got.headers.get("x-robots-tag"), "html": got.body.decode("utf-8", "replace") if page else None, "redirect_chain": got.chain, "response_bytes": len(got.body)}


def fetch_pages(urls: DataFrame, config: dict, **how) -> DataFrame:
    """Rows of PAGE for ``urls`` (snapshot_id, url). A site's requests are made by one task, which paces them."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        gates: dict[str, RequestGate] = {}
        for frame in frames:
            for a in range(0, len(frame), 64):  # few bodies in memory at a time
                part = frame.iloc[a : a + 64]
                yield pd.DataFrame([page_row(s, u, gates.setdefault(s, RequestGate(config["delay"] / 1000)), config, **how) for s, u in zip(part["snapshot_id"], part["url"], strict=True)])

    return urls.select("snapshot_id", "url").repartition("snapshot_id").mapInPandas(run, PAGE)


def fetch_texts(urls: DataFrame, config: dict, **how) -> DataFrame:
    """(snapshot_id, url, status, body, error) of ``urls`` (snapshot_id, url): files such as robots.txt, one request after the other for each site."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        gates: dict[str, RequestGate] = {}
        for frame in frames:
            rows = []
            for site, url in zip(frame["snapshot_id"], frame["url"], strict=True):
                try:
                    got = fetch(url, gates.setdefault(site, RequestGate(config["delay"] / 1000)), config, **how)
                    rows.append((site, url, got.status, got.body.decode("utf-8", "replace"), None))
                except (RequestFailure, OSError) as e:
                    rows.append((site, url, getattr(e, "status", None), None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["snapshot_id", "url", "status", "body", "error"]).astype({"status": "Int64"})

    return urls.select("snapshot_id", "url").repartition("snapshot_id").mapInPandas(run, "snapshot_id string, url string, status long, body string, error string")


@dataclass
class Plan:
    start_url: str
    origin: str
    mode: str
    candidates: DataFrame


def plan_scan(start: str, sitemap_urls: DataFrame | None, spark, include_query: bool = False) -> Plan:
    """The start URL and, with a sitemap, its URLs (column url), each once; ``rank`` is 0 for the start URL, else 1 (order: rank, url)."""
    url = normalize(start, None, include_query)
    if url is None:
        raise ValueError(f"invalid start URL: {start}")
    first = spark.createDataFrame([(url,)], "url string")
    rows = first if sitemap_urls is None else first.unionByName(sitemap_urls.select("url")).distinct()
    parts = urlsplit(url)
    return Plan(url, f"{parts.scheme}://{parts.netloc}", "links" if sitemap_urls is None else "sitemap", rows.withColumn("rank", F.when(F.col("url") == url, 0).otherwise(1)))


def menu_choice(answer: str, pages: int) -> tuple[str, int] | None:
    """(mode, pages to scan) of a menu's answer: nothing or 1, 2 or all, 3 or step, or a number of pages; None if it is none of these."""
    answer = answer.strip().lower()
    named = {"": ("fixed", min(100, pages)), "2": ("all", pages), "3": ("step", pages), "all": ("all", pages), "step": ("step", pages), "1": ("fixed", min(100, pages))}
    if answer in named:
        return named[answer]
    return ("fixed", min(int(answer), pages)) if re.fullmatch("[0-9]+", answer) and int(answer) > 0 else None


def steps(pages: int, done: int = 0, size: int = 100) -> Iterator[int]:
    """Page limits of a scan in steps; ``done`` pages are there already, as a resumed scan has them."""
    while done < pages:
        done = min(done + size, pages)
        yield done


class ReportThrottle:
    """Whether a partial report is due: 100 pages or 5 seconds after the last one."""

    def __init__(self, pages: int = 100, seconds: float = 5.0, clock=time.monotonic) -> None:
        self.pages, self.seconds, self.clock, self.last, self.at = pages, seconds, clock, 0, clock()

    def due(self, pages: int) -> bool:
        if pages <= self.last or (pages - self.last < self.pages and self.clock() - self.at < self.seconds):
            return False
        self.last, self.at = pages, self.clock()
        return True


def rekey(baseline: DataFrame, checked, source: str, target: str) -> DataFrame:
    """The pages of ``baseline`` as another host has them: ``checked`` turns rows (snapshot_id, url) into pages; url and final_url are mapped back.

    Two URLs of the baseline with one target both get its page.
    """
    wanted = baseline.select("snapshot_id", F.col("url").alias("_own"), map_origin(F.col("url"), F.lit(source), F.lit(target)).alias("url"))
    pages = checked(wanted.select("snapshot_id", "url").distinct())
    back = pages.join(wanted, ["snapshot_id", "url"])
    final = map_origin(F.col("final_url"), F.lit(target), F.lit(source))
    return back.withColumn("url", F.col("_own")).withColumn("final_url", final).select(pages.columns)
