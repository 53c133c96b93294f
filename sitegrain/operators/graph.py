"""Link graph, crawl statistics and health of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import empty, has_directive


def unavailable() -> Column:
    return ~empty(F.col("error")) | F.coalesce("blocked", F.lit(False)) | (F.coalesce("status", F.lit(500)) >= 400)


def failed() -> Column:
    return ~empty(F.col("error")) | (F.coalesce("status", F.lit(500)) >= 400)


def linked_urls(pages: DataFrame) -> DataFrame:
    """(snapshot_id, url) of all targets of internal links, each once."""
    return pages.select("snapshot_id", F.explode("internal_links").alias("url")).distinct()


def orphans(pages: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """(snapshot_id, url) of sitemap URLs that were crawled but are not linked."""
    on = ["snapshot_id", "url"]
    return sitemap_urls.select(on).distinct().join(pages.select(on), on, "left_semi").join(linked_urls(pages), on, "left_anti")


def link_graph(pages: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """One row per snapshot: edges and numbers of orphan and broken pages. The URLs themselves: ``orphans``, ``broken``."""
    edges = pages.groupBy("snapshot_id").agg(F.sum(F.size("internal_links")).cast("long").alias("internal_edges"), F.sum(F.size("external_links")).cast("long").alias("external_edges"), F.count_if(unavailable()).alias("broken_pages"))
    lost = orphans(pages, sitemap_urls).groupBy("snapshot_id").agg(F.count("*").alias("orphan_pages"))
    return edges.join(lost, "snapshot_id", "left").withColumn("orphan_pages", F.coalesce("orphan_pages", F.lit(0).cast("long")))


def broken(pages: DataFrame) -> DataFrame:
    return pages.filter(unavailable()).select("snapshot_id", "url")


def statistics(pages: DataFrame) -> DataFrame:
    """One row per snapshot. Blocked pages have no status, so they are among the failed ones and taken off twice."""
    n, bad, blocked = F.count("*"), F.count_if(failed()), F.count_if(F.coalesce("blocked", F.lit(False)))
    moved = (F.size("redirect_chain") > 0) | ~F.col("url").eqNullSafe(F.col("final_url"))
    return pages.groupBy("snapshot_id").agg(n.alias("completed"), (n - bad - blocked).alias("succeeded"), bad.alias("failed"), blocked.alias("blocked_by_robots"), F.count_if(moved).alias("redirected"))


def health(pages: DataFrame) -> DataFrame:
    one = {"unavailable": unavailable(), "missing_title": empty(F.col("title")), "missing_description": empty(F.col("description")), "missing_canonical": empty(F.col("canonical")), "missing_h1": F.col("h1_count") == 0, "noindex": has_directive(F.col("robots"), "noindex")}
    return pages.groupBy("snapshot_id").agg(*[F.count_if(c).alias(k) for k, c in one.items()])
