"""Whole scans of many sites over tables: robots.txt, seeds, crawl by levels with cached pages, page logs.

The transport is a function from (snapshot_id, url) to fetched rows, so that a scan runs over HTTP
(``scan.fetch_pages``) or over a table. Each level is a few joins; the driver holds only whether a level is empty.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.urls import is_crawlable, origin, path_and_query
from ..sources.html import extract_pages
from ..sources.robots import parse_robots, pattern_regex
from .crawl import checkpointed

#: Fixed limit of a robots.txt, and URLs that a scan schedules for each page that it may fetch.
ROBOTS_BYTES, QUEUE = 512 * 1024, 10
RULES = "array<struct<kind:string,path:string,regex:string>>"
_RULE = pa.list_(pa.struct([("kind", pa.string()), ("path", pa.string()), ("regex", pa.string())]))
SITE = ["snapshot_id", "url"]


def _parser(agent: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = [[{"kind": k, "path": p, "regex": pattern_regex(p)} for k, p in parse_robots(b, agent)] for b in batch["body"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["snapshot_id"], pa.array(rules, _RULE)], names=["snapshot_id", "rules"])

    return run


def robots_of(sites: DataFrame, texts: Callable[[DataFrame], DataFrame], agent: str) -> DataFrame:
    """One row per site (snapshot_id, start_url): robots_url, robots_status, robots_sha, robots_error, deny_all, rules.

    ``texts`` gives (snapshot_id, url, status, body, error). 401 and 403 deny all, other failures nothing; rules count only with a success.
    """
    urls = sites.select("snapshot_id", F.concat(origin(F.col("start_url")), F.lit("/robots.txt")).alias("url"))
    got = checkpointed(texts(urls).select("snapshot_id", "url", "status", F.substring("body", 1, ROBOTS_BYTES).alias("body"), "error"))
    fine = got.filter("error is null and status between 200 and 299").select("snapshot_id", "body")
    rules = fine.mapInArrow(_parser(agent), f"snapshot_id string, rules {RULES}")
    sha = F.when(F.col("error").isNull(), F.sha2(F.coalesce("body", F.lit("")), 256))
    out = got.select("snapshot_id", F.col("url").alias("robots_url"), F.when(F.col("error").isNull(), F.col("status")).alias("robots_status"), sha.alias("robots_sha"), F.col("error").alias("robots_error"), (F.col("error").isNull() & F.col("status").isin(401, 403)).alias("deny_all"))
    return out.join(rules, "snapshot_id", "left").withColumn("rules", F.coalesce("rules", F.array().cast(RULES)))


def allowed_by(path: Column, rules: Column, deny_all: Column) -> Column:
    """Like ``robots.allowed`` with the rules in a column."""
    longest = lambda kind: F.aggregate(F.filter(rules, lambda r: (r["kind"] == kind) & F.rlike(path, r["regex"])), F.lit(-1), lambda n, r: F.greatest(n, F.length(r["path"])))
    return ~deny_all & (longest("allow") >= longest("disallow"))


@dataclass
class Scan:
    pages: DataFrame
    sites: DataFrame  # snapshot_id, robots columns, completed, truncated, partial


def _cut(rows: DataFrame, most: Column, *order: str) -> DataFrame:
    """The first ``most`` rows of each site; what is left out has ``kept`` false."""
    nth = F.row_number().over(Window.partitionBy("snapshot_id").orderBy(*order))
    return rows.withColumn("kept", nth <= most)


def scan_sites(
    sites: DataFrame, pages_of: Callable[[DataFrame], DataFrame], texts_of: Callable[[DataFrame], DataFrame], config: dict, sitemap_urls: DataFrame | None = None,
    cached: DataFrame | None = None, agent: str = "sitegrain", on_level: Callable[[int, DataFrame], None] | None = None, stop: Callable[[], bool] = lambda: False,
) -> Scan:
    """Scans ``sites`` (snapshot_id, start_url), each to ``maxPages`` pages.

    Seeds are the start URL, then ``sitemap_urls`` (snapshot_id, url) in order, cut to the limit before anything is
    sorted. Pages that robots.txt forbids are rows with ``blocked``; ``cached`` pages (as an earlier scan returned
    them) are not fetched again. At most QUEUE times the limit is scheduled. ``on_level`` gets each level's number
    and new pages; ``stop`` is asked between levels, and ends the scan as partial.
    """
    most = config["maxPages"]
    robots = checkpointed(robots_of(sites, texts_of, agent))
    seeds = sites.select("snapshot_id", F.col("start_url").alias("url"), F.lit(0).alias("rank"))
    if sitemap_urls is not None:
        seeds = seeds.unionByName(sitemap_urls.select("snapshot_id", "url", F.lit(1).alias("rank")))
    seeds = seeds.groupBy(SITE).agg(F.min("rank").alias("rank"))
    level = checkpointed(_cut(seeds, F.lit(most), "rank", "url").filter("kept").select(*SITE, F.lit(0).alias("depth")))
    scheduled, done, more = level.select(SITE), None, None
    partial = False
    for depth in itertools.count():
        if level.isEmpty():
            break
        if stop():
            partial = True
            break
        used = level.select("snapshot_id").distinct().withColumn("used", F.lit(0)) if done is None else done.groupBy("snapshot_id").agg(F.count("*").alias("used"))
        ranked = checkpointed(_cut(level.join(used, "snapshot_id", "left"), F.lit(most) - F.coalesce("used", F.lit(0)), "url"))
        cut = ranked.filter(~F.col("kept")).select("snapshot_id").distinct()
        more = cut if more is None else checkpointed(more.unionByName(cut).distinct())
        now = ranked.filter("kept").select(*SITE, "depth")
        fetched = checkpointed(_pages(now, robots, pages_of, cached, config))
        done = fetched if done is None else checkpointed(done.unionByName(fetched))
        if on_level:
            on_level(depth, fetched)
        links = fetched.select("snapshot_id", F.col("url").alias("source"), F.explode("internal_links").alias("url")).filter(is_crawlable(F.col("url")))
        new = links.groupBy(SITE).agg(F.min("source").alias("source")).join(scheduled, SITE, "left_anti")
        queued = scheduled.groupBy("snapshot_id").agg(F.count("*").alias("queued"))
        room = F.lit(QUEUE * most) - F.coalesce("queued", F.lit(0))
        level = checkpointed(_cut(new.join(queued, "snapshot_id", "left"), room, "source", "url").filter("kept").select(*SITE, F.lit(depth + 1).alias("depth")))
        scheduled = checkpointed(scheduled.unionByName(level.select(SITE)))
    done = done if done is not None else _pages(level, robots, pages_of, cached, config)
    counts = done.groupBy("snapshot_id").agg(F.count("*").alias("completed"))
    listed = None if sitemap_urls is None else sitemap_urls.distinct().groupBy("snapshot_id").agg(F.count("*").alias("listed"))
    out = robots.drop("rules").join(counts, "snapshot_id", "left").withColumn("completed", F.coalesce("completed", F.lit(0)))
    out = out.withColumn("listed", F.lit(0)) if listed is None else out.join(listed, "snapshot_id", "left")
    left = level.select("snapshot_id").distinct().withColumn("left", F.lit(True))
    out = out.join(left, "snapshot_id", "left") if more is None else out.join(left.unionByName(more.withColumn("left", F.lit(True))).distinct(), "snapshot_id", "left")
    truncated = F.lit(partial) | F.coalesce("left", F.lit(False)) | (F.coalesce("listed", F.lit(0)) > F.col("completed"))
    return Scan(done, out.withColumn("truncated", truncated).withColumn("partial", F.lit(partial)).drop("left", "listed"))


def cached_pages(*sources: DataFrame) -> DataFrame:
    """One table of pages for ``scan_sites`` from several (logs, earlier scans); of a page in more than one, that in the last source counts."""
    rows = None
    for n, source in enumerate(sources):
        one = source.select(*SITE, F.struct(F.lit(n).alias("_nth"), *[c for c in source.columns if c not in SITE]).alias("r"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy(SITE).agg(F.max_by("r", "r._nth").alias("r"))
    return best.select(*SITE, *[F.col(f"r.{c}").alias(c) for c in sources[0].columns if c not in SITE])


def _pages(now: DataFrame, robots: DataFrame, pages_of, cached: DataFrame | None, config: dict) -> DataFrame:
    """The pages of a level: cached ones (at the depth that they have), blocked ones and fetched ones."""
    wanted = now if cached is None else now.join(cached.select(SITE), SITE, "left_anti")
    asked = wanted.join(robots.select("snapshot_id", "deny_all", "rules"), "snapshot_id", "left")
    may = F.coalesce(allowed_by(path_and_query(F.col("url")), F.col("rules"), F.col("deny_all")), F.lit(True)) if config.get("respectRobots", True) else F.lit(True)
    asked = asked.select(*SITE, "depth", may.alias("may"))
    got = extract_pages(pages_of(asked.filter("may").select(SITE)), config.get("includeQuery", False)).drop("visible_text")
    fresh = got.join(asked.filter("may").select(*SITE, "depth"), SITE).withColumn("blocked", F.lit(False))
    empty = {c.name: F.lit(None).cast(c.dataType) for c in got.schema.fields if c.name not in SITE}
    none = F.array().cast("array<string>")
    empty |= {c: none for c in ("links", "internal_links", "external_links")} | {"h1_count": F.lit(0), "word_count": F.lit(0)}
    held = asked.filter("not may").select(*SITE, "depth", *[v.alias(c) for c, v in empty.items()]).withColumn("blocked", F.lit(True))
    out = fresh.unionByName(held.select(fresh.columns))
    if cached is not None:
        out = out.unionByName(cached.join(now.select(SITE), SITE, "left_semi").select(out.columns))
    return out


def table_transport(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Answers from a table (snapshot_id, url, html, perhaps status and the like); URLs that it lacks are 404."""
    def get(urls: DataFrame) -> DataFrame:
        have = set(table.columns)
        got = urls.join(table.withColumn("_known", F.lit(True)), SITE, "left")
        status = F.when(F.col("_known"), F.coalesce(F.col("status") if "status" in have else F.lit(200), F.lit(200))).otherwise(404)
        chain = F.col("redirect_chain") if "redirect_chain" in have else F.array().cast("array<struct<url:string,status:int,location:string>>")
        field = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string").alias(c)
        return got.select(*SITE, F.coalesce(field("final_url"), F.col("url")).alias("final_url"), status.cast("int").alias("status"), field("x_robots"), field("error"), "html", chain.alias("redirect_chain"))

    return get


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sites of the page table, the table being the transport; a rule of robots.txt for every site whose first page has an even number."""
    from ..functions.urls import normalize_url

    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", normalize_url(F.col("url")).alias("url"), origin(F.col("url")).alias("snapshot_id"), "html").filter("url is not null")
    table = checkpointed(raw.groupBy("snapshot_id", "url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html")))
    firsts = checkpointed(table.groupBy("snapshot_id").agg(F.min_by("url", "page_id").alias("start_url"), F.min("page_id").alias("least")))
    body = F.when(F.col("least") % 2 == 0, "User-agent: *\nDisallow: /en/\nAllow: /en/1").otherwise("")
    texts = lambda urls: urls.join(firsts, "snapshot_id").select(*SITE, F.lit(200).alias("status"), body.alias("body"), F.lit(None).cast("string").alias("error"))
    listed = table.select(SITE)
    found = scan_sites(firsts.select("snapshot_id", "start_url"), table_transport(table.select(*SITE, "html")), texts, {"maxPages": 1_000_000}, listed)
    return found.pages.select("snapshot_id", "url", F.col("depth").cast("long").alias("depth"), F.col("status").cast("long").alias("status"), "blocked", F.col("h1_count").cast("long").alias("h1_count"))
