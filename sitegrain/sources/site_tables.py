"""Snapshots made from a raw page table: each site's pages with evidence derived from the page's number.

Raw pages have no crawl evidence (status, redirects, robots verdicts) and little markup. The markup is written
into the HTML before the real extraction; crawl evidence is computed from the number. ``shift`` gives another
state of the same sites.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.urls import normalize_url, origin
from ..plans.crawl import stored
from .html import extract_pages


@dataclass
class Snapshot:
    pages: DataFrame
    sites: DataFrame
    sitemap_urls: DataFrame


def _every(k: Column, n: int, rest: int = 0) -> Column:
    return k % n == rest


#: A page that stands at several URLs.
COPY = '<html lang="en"><head><meta charset="utf-8"><title>Copy</title></head><body><h1>Copy</h1><p>The same text stands on several pages of this site.</p></body></html>'


def variant(k: Column, html: Column) -> Column:
    """The page with another text, title, heading or language, as its number says."""
    html = F.when(_every(k, 8, 7), COPY).otherwise(html)
    title = F.when(_every(k, 4, 3), "<title>A title that pages share</title>").when(_every(k, 16, 1), "<title></title>").when(_every(k, 16, 5), "<title>Short</title>")
    html = F.when(title.isNotNull(), F.regexp_replace(html, F.lit("(?s)<title>.*?</title>"), title)).otherwise(html)
    html = F.when(_every(k, 14, 2), F.replace(html, F.lit("<h1"), F.lit("<h2"))).otherwise(html)
    return F.when(_every(k, 22, 4), F.replace(html, F.lit('<html lang="'), F.lit('<html lang="xx_'))).otherwise(html)


def markup(k: Column, path: Column, site: Column) -> Column:
    """What is written after the charset declaration; ``path`` is the next page's (null for none)."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    number = k.cast("string")
    description = F.when(_every(k, 5), "").when(_every(k, 7), '<meta name="description" content="A description that several pages of this site have in common.">').when(_every(k, 26, 11), '<meta name="description" content="Too short.">').otherwise(
        text('<meta name="description" content="Page ', number, ' of this site has a description of its own, long enough to be useful.">')
    )
    canonical = F.when(_every(k, 6), "").when(_every(k, 23), '<link rel="canonical" href="http://[bad">').when(_every(k, 19), '<link rel="canonical" href="https://elsewhere.example.org/c">').when(_every(k, 34, 9), text('<link rel="canonical" href="', F.regexp_replace(site, "^https?", "http"), '/c">')).otherwise('<link rel="canonical" href="?">')
    robots = F.when(_every(k, 11), '<meta name="robots" content="noindex, follow">').otherwise("")
    alternate = F.when(_every(k, 13), '<link rel="alternate" hreflang="en_bad" href="/alternate">').otherwise('<link rel="alternate" hreflang="en" href="/alternate">')
    data = F.when(_every(k, 17), '<script type="application/ld+json">{"a":</script>').otherwise('<script type="application/ld+json">{"a": 1}</script>')
    image = F.when(_every(k, 4), '<img src="/a.png">').otherwise('<img src="/a.png" alt="">')
    graph = text('<meta property="og:title" content="t"><meta property="og:description" content="d">', F.when(_every(k, 3), '<meta property="og:image" content="/i.png">').otherwise(""))
    card = text('<meta name="twitter:card" content="summary"><meta name="twitter:title" content="t"><meta name="twitter:description" content="d">', F.when(_every(k, 8), '<meta name="twitter:image" content="/i.png">').otherwise(""))
    heading = F.when(_every(k, 9), "<h1>Extra</h1>").otherwise("")
    link = F.when(path.isNotNull() & ~_every(k, 5, 1), text('<a href="', path, '">next</a>')).otherwise("")
    return F.concat(description, canonical, robots, alternate, data, image, graph, card, heading, link)


CHARSET = '<meta charset="utf-8">'


def snapshot(spark: SparkSession, sf_dir: str, shift: int = 0) -> Snapshot:
    """The sites of ``pages.parquet``, all pages. Other shifts have invented pages beside them, which are missing in the state of shift 0."""
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet")
    keyed = raw.select("page_id", normalize_url(F.col("url")).alias("url"), origin(F.col("url")).alias("snapshot_id")).filter("url is not null")
    keyed = keyed.groupBy("snapshot_id", "url").agg(F.min("page_id").alias("page_id"))
    if shift:
        keyed = keyed.unionByName(keyed.filter("page_id % 43 = 0").withColumn("url", F.concat("url", F.lit("-gone"))))
    next_url = F.lead("url").over(Window.partitionBy("snapshot_id").orderBy("page_id", "url"))
    k = F.col("page_id") + F.lit(shift)
    path = F.substr(next_url, F.length("snapshot_id") + 1)
    # Numbers and neighbours come from narrow rows; the HTML is moved once, by the page's number, also where the join would not: parsing is the work of many tasks.
    injected = keyed.withColumn("k", k).withColumn("path", path).join(raw.select("page_id", "html").repartition("page_id"), "page_id").withColumn("html", variant(F.col("k"), F.col("html")))
    injected = injected.withColumn("html", F.replace("html", F.lit(CHARSET), F.concat(F.lit(CHARSET), markup(F.col("k"), F.col("path"), F.col("snapshot_id"))))).drop("path")
    k = F.col("k")
    blocked = _every(k, 29)
    error = F.when(blocked, None).when(_every(k, 31), "redirect loop detected").when(_every(k, 37), "timeout")
    hops = F.when(_every(k, 10), k % 6).otherwise(0).cast("int")
    moved = F.when(~blocked & error.isNull(), F.when(hops > 0, F.concat("snapshot_id", F.lit("/moved"))).otherwise(F.col("url")))
    pages = extract_pages(injected.withColumn("final_url", moved))
    hop = F.struct(F.col("url").alias("url"), F.lit(301).alias("status"), F.concat("snapshot_id", F.lit("/moved")).alias("location"))
    reached = ~blocked & error.isNull()
    pages = pages.select(
        "*", blocked.alias("blocked"), error.alias("error"),
        F.when(reached, F.when(_every(k, 13, 1), 404).when(_every(k, 17, 1), 503).otherwise(200)).cast("int").alias("status"),
        F.when(_every(k, 41), "noindex").alias("x_robots"), F.array_repeat(hop, hops).alias("redirect_chain"),
    ).drop("visible_text")
    pages = stored(pages, "snapshot")  # parsed once, whatever joins follow
    listed = pages.filter("k % 3 != 0").select("snapshot_id", "url")
    facts = keyed.groupBy("snapshot_id").agg(F.min("page_id").alias("least"), F.count_if((F.col("page_id") + shift) % 3 != 0).alias("sitemap_count"))
    sites = facts.select(
        "snapshot_id", F.concat("snapshot_id", F.lit("/")).alias("site_url"), F.lit(True).alias("has_sitemap"), F.concat("snapshot_id", F.lit("/sitemap.xml")).alias("sitemap_url"),
        F.when(F.col("least") % 7 == 0, "HTTP 503").alias("sitemap_error"), F.concat("snapshot_id", F.lit("/robots.txt")).alias("robots_url"),
        F.sha2(F.concat(F.lit("robots "), F.when(F.col("least") % 2 == 0, F.lit(shift)).otherwise(0).cast("string")), 256).alias("robots_sha"),
        F.col("sitemap_count").cast("long").alias("sitemap_count"), (F.col("least") % 5 != 0).alias("complete"),
    )
    return Snapshot(pages, sites, listed)
