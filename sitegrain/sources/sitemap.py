"""Sitemaps: XML (plain or gzip) to URLs."""

from __future__ import annotations

import re
import zlib
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.urls import is_crawlable, normalize_url, origin

#: Fixed limits.
MAX_BYTES, MAX_FILES, MAX_URLS = 10 * 1024 * 1024, 100, 50_000


def locations(xml: Column, kind: str = "urlset") -> Column:
    """``loc`` texts of a urlset (or a sitemapindex), namespaces aside."""
    return F.xpath(xml, F.lit(f'/*[local-name()="{kind}"]/*/*[local-name()="loc"]/text()'))


def sitemap_urls(maps: DataFrame, site: str = "site", xml: str = "xml") -> DataFrame:
    """(site, url) of all sitemaps: same origin, crawlable, normalised, each once."""
    urls = maps.select(site, F.explode(locations(F.col(xml))).alias("loc")).select(site, normalize_url(F.trim("loc"), include_query=True).alias("url"))
    return urls.filter((origin(F.col("url")) == F.col(site)) & is_crawlable(F.col("url"))).distinct()


def decode(body: bytes, name: str = "", content_type: str = "") -> str:
    """Text of a sitemap file, unpacked if it is gzip; ValueError if it is too large either way."""
    if len(body) > MAX_BYTES:
        raise ValueError("sitemap is too large")
    if name.endswith(".gz") or "gzip" in content_type or body[:2] == b"\x1f\x8b":
        unpack = zlib.decompressobj(31)
        body = unpack.decompress(body, MAX_BYTES + 1)  # no more than is needed to tell
        if len(body) > MAX_BYTES:
            raise ValueError("sitemap is too large")
    return body.decode("utf-8", "replace")


def load(start: str, fetch, max_files: int = MAX_FILES, max_urls: int = MAX_URLS, include_query: bool = False) -> dict:
    """Through sitemap indexes, at most ``max_files`` files. ``fetch(url)`` gives bytes. Returns url, urls (sorted; crawlable ones of the site, without queries unless asked for), files, truncated, error."""
    from ..functions.urls import crawlable, normalize

    home = "/".join(start.split("/")[:3])
    queue, seen, urls, files = [start], {start}, set(), 0
    out = {"url": start, "urls": [], "files": 0, "truncated": False, "error": None}
    try:
        while queue and files < max_files and len(urls) < max_urls:
            at = queue.pop(0)
            files += 1
            root = ElementTree.fromstring(decode(fetch(at), at))
            found = [e.text.strip() for child in root for e in child if e.tag.rpartition("}")[2] == "loc" and e.text]
            for loc in found:
                index = root.tag.rpartition("}")[2] == "sitemapindex"
                full = normalize(loc, at, include_query=index or include_query)
                if not full or "/".join(full.split("/")[:3]) != home:
                    continue
                if index:
                    if full not in seen:
                        seen.add(full), queue.append(full)
                elif crawlable(full) and len(urls) < max_urls:
                    urls.add(full)
            queue.sort()
        out |= {"truncated": bool(queue) or files >= max_files or len(urls) >= max_urls}
    except (ValueError, OSError, ElementTree.ParseError) as e:
        out["error"] = str(e)
    return out | {"urls": sorted(urls), "files": files}


#: Where sitemaps lie if robots.txt names none.
USUAL = ("/sitemap.xml", "/sitemap.xml.gz", "/sitemap_index.xml")


def discover(start: str, robots_body: str | None, fetch) -> str | None:
    """The site's sitemap: the first of its own origin that robots.txt names, else the first usual place with a sitemap; None without one."""
    from ..functions.urls import normalize

    home = "/".join((normalize(start) or "").split("/")[:3])
    for loc in re.findall(r"(?im)^sitemap:\s*(\S+)\s*$", robots_body or ""):
        full = normalize(loc, f"{home}/robots.txt", include_query=True)
        if full and "/".join(full.split("/")[:3]) == home:
            return full
    for path in USUAL:
        try:
            root = ElementTree.fromstring(decode(fetch(home + path), path))
        except (ValueError, OSError, KeyError, ElementTree.ParseError):
            continue
        if root.tag.rpartition("}")[2] in ("urlset", "sitemapindex"):
            return home + path
    return None
