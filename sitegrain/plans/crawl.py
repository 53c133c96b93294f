"""Breadth-first crawl over tables: a level at a time, each a few joins.

The driver holds only counts. A level's URLs are ranked, cut to what is left of the page limit, joined with the
page table (the offline transport) or fetched (``fetch`` in mapInPandas, one origin per task so that requests
are paced), and their links become the next level unless they were scheduled before.
"""

from __future__ import annotations

import itertools
import time

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.urls import is_crawlable


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``; only where none is set and all runs on one machine (tests) is one made."""
    import tempfile

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one, removed when the session ends."""
    import uuid

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4()}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a level in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and later plans read only the columns that they need."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crawl(seeds: DataFrame, pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(site, url, depth) of pages reached from ``seeds`` (site, url) by ``pages`` (site, url, internal_links).

    With ``max_pages``, each site's pages are cut to that number, by depth and then by URL. Links are followed
    within the site, and only crawlable ones; each URL is scheduled once. It ends when no URL is left, at whatever
    depth.

    Levels are shuffled to the pages, never broadcast: what goes through the driver does not grow with the tables.
    """
    level = checkpointed(seeds.select("site", "url").distinct().withColumn("depth", F.lit(0)))
    scheduled = level.select("site", "url")
    done = None
    for depth in itertools.count():
        if level.isEmpty():
            break
        if max_pages is not None:
            used = None if done is None else done.groupBy("site").agg(F.count("*").alias("used"))
            ranked = level.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("url")))
            ranked = ranked.withColumn("used", F.lit(0)) if used is None else ranked.join(used.hint("merge"), "site", "left")
            level = checkpointed(ranked.filter(F.col("nth") + F.coalesce("used", F.lit(0)) <= max_pages).select("site", "url", "depth"))
        done = level if done is None else checkpointed(done.unionByName(level))
        links = level.hint("merge").join(pages, ["site", "url"]).select("site", F.explode("internal_links").alias("url")).distinct().filter(is_crawlable(F.col("url")))
        level = checkpointed(links.join(scheduled.hint("merge"), ["site", "url"], "left_anti").withColumn("depth", F.lit(depth + 1)))
        scheduled = checkpointed(scheduled.unionByName(level.select("site", "url")))
    return done if done is not None else level


class RequestGate:
    """Spaces the starts of requests of one origin by ``delay`` seconds."""

    def __init__(self, delay: float, clock=time.monotonic, sleep=time.sleep) -> None:
        self.delay, self.clock, self.sleep, self.next = delay, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        at = max(now, self.next)
        self.next = at + self.delay
        if at > now:
            self.sleep(at - now)


def retry_delay(attempt: int, retry_after: float | None = None, jitter: float = 0.0) -> float:
    """Milliseconds before the next attempt: what the server asks for, else doubling from 250; 30 s at most."""
    return min(30_000.0, max(0.0, retry_after * 1000) if retry_after is not None else 250 * 2**attempt + jitter)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.site_tables import snapshot

    s = snapshot(spark, sf_dir)
    pages = checkpointed(s.pages.select(F.col("snapshot_id").alias("site"), "url", "page_id", "internal_links"))
    listed = s.sitemap_urls.select(F.col("snapshot_id").alias("site"), "url").filter(is_crawlable(F.col("url")))
    seeds = pages.groupBy("site").agg(F.min_by("url", "page_id").alias("url")).unionByName(listed)
    reached = crawl(seeds, pages.select("site", "url", "internal_links"))
    return reached.select("site", "url", F.col("depth").cast("long").alias("depth"))
