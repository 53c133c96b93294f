"""Rules on groups of pages, on a stream: how many pages share a title and how many link to a URL is kept up to date.

A batch's pages are held against what the table had for their URLs before; the difference, -1 for a title or link
that went and +1 for one that came, is the batch's entry. So a batch costs what it changes, whatever there is. Each batch
is one folder, overwritten when the batch is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import empty, group_key
from .page_table import KeyedTable

PAGE = "snapshot_id string, url string, title string, internal_links array<string>, blocked boolean, error string, seq long"
KEYS = ["snapshot_id", "url"]


def _entries(pages: DataFrame, sign: int) -> DataFrame:
    """(kind, snapshot_id, value, n): the title of each page and the targets of its links."""
    title = pages.select(F.lit("title").alias("kind"), "snapshot_id", group_key(F.col("title")).alias("value"))
    links = pages.select(F.lit("link").alias("kind"), "snapshot_id", F.explode(F.array_distinct("internal_links")).alias("value"))
    return title.unionAll(links).filter("value is not null").withColumn("n", F.lit(sign).cast("long"))


class GroupRules:
    """duplicate-title and orphan-sitemap-page over pages that come and change in batches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.pages = KeyedTable(spark, f"{path}/pages", PAGE, KEYS, "seq")

    def take(self, batch: DataFrame, number: int) -> None:
        """Rows of PAGE; of a URL's rows the one with the highest seq counts, also against older batches."""
        own = self.pages.last(batch.withColumn("batch", F.lit(number).cast("long"))).drop("batch").persist()
        old = self.pages.read(number).join(own.select(*KEYS, F.col("seq").alias("new_seq")), KEYS).filter("seq <= new_seq").drop("new_seq").persist()
        late = self.pages.read(number).join(own.select(*KEYS, F.col("seq").alias("new_seq")), KEYS).filter("seq > new_seq").select(KEYS)
        change = _entries(own.join(late, KEYS, "left_anti"), 1).unionAll(_entries(old, -1)).groupBy("kind", "snapshot_id", "value").agg(F.sum("n").alias("n")).filter("n != 0")
        change.write.mode("overwrite").parquet(f"{self.path}/counts/batch={number}")
        self.pages.upsert(own, number)
        own.unpersist()
        old.unpersist()

    def counts(self, kind: str) -> DataFrame:
        """(snapshot_id, value, n) of titles or link targets."""
        changes = self.spark.read.schema("kind string, snapshot_id string, value string, n long").parquet(f"{self.path}/counts/batch=*")
        return changes.filter(F.col("kind") == kind).groupBy("snapshot_id", "value").agg(F.sum("n").alias("n")).filter("n > 0")

    def findings(self, sitemap_urls: DataFrame) -> DataFrame:
        """(rule, snapshot_id, url) as the audit of all pages gives them now."""
        ok = self.pages.read().filter(~F.coalesce("blocked", F.lit(False)) & empty(F.col("error")))
        shared = self.counts("title").filter("n > 1").select("snapshot_id", F.col("value").alias("key"))
        twice = ok.withColumn("key", group_key(F.col("title"))).join(shared, ["snapshot_id", "key"], "left_semi")
        linked = self.counts("link").select("snapshot_id", F.col("value").alias("url"))
        alone = ok.join(sitemap_urls.select(KEYS).distinct(), KEYS, "left_semi").join(linked, KEYS, "left_anti").filter(F.col("url") != F.concat("snapshot_id", F.lit("/")))
        return twice.select(F.lit("duplicate-title").alias("rule"), *KEYS).unionAll(alone.select(F.lit("orphan-sitemap-page").alias("rule"), *KEYS))


def follow(rules: GroupRules, pages_path: str, checkpoint: str) -> None:
    """Take up what a folder of pages (Parquet, PAGE) has now, and end; a second call goes on from there."""
    stream = rules.spark.readStream.schema(PAGE).parquet(pages_path)
    stream.writeStream.foreachBatch(rules.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages in two waves: first every third one with another title and without links, then these again as they are."""
    from ..plans.crawl import shared_folder
    from ..sources import site_tables

    s = site_tables.snapshot(spark, sf_dir)
    root = shared_folder(spark, "group-rules")
    rules = GroupRules(spark, root)
    third = F.col("page_id") % 3 == 0
    now = s.pages.select("snapshot_id", "url", "title", "internal_links", "blocked", "error", F.col("page_id").alias("seq"), "page_id")
    before = now.withColumn("title", F.when(third, "A title that goes").otherwise(F.col("title"))).withColumn("internal_links", F.when(third, F.array().cast("array<string>")).otherwise(F.col("internal_links")))
    for wave in (before, now.filter(third).withColumn("seq", F.col("seq") + 10_000_000)):
        wave.drop("page_id").write.mode("append").parquet(f"{root}/in")
        follow(rules, f"{root}/in", f"{root}/state")
    return rules.findings(s.sitemap_urls)
