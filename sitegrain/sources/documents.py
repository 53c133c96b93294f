"""Snapshot documents: JSON files of versions 1 and 2, read into page tables and written as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_CARD = "title:string,description:string,image:string"
PAGE = (
    "url:string,finalUrl:string,status:int,contentType:string,blockedByRobots:boolean,error:string,title:string,description:string,canonical:string,canonicalRaw:string,"
    f"robots:string,xRobotsTag:string,lang:string,h1Count:int,openGraph:struct<{_CARD}>,twitter:struct<card:string,{_CARD}>,hreflang:array<struct<lang:string,url:string>>,"
    "images:array<struct<src:string,alt:string>>,links:array<string>,internalLinks:array<string>,externalLinks:array<string>,wordCount:int,contentHash:string,depth:int,"
    "redirectChain:array<struct<url:string,status:int,location:string>>,responseBytes:long"
)
DOCUMENT = f"schemaVersion int, siteUrl string, startUrl string, generatedAt string, partial boolean, truncated boolean, sitemap struct<url:string,urls:array<string>,sitemapCount:int,truncated:boolean,error:string>, pages array<struct<{PAGE}>>"
#: What a page has where its document says nothing.
ZERO, NO, EMPTY, SORTED = ("h1Count", "wordCount", "depth", "responseBytes"), ("blockedByRobots",), ("hreflang", "images", "redirectChain"), ("links", "internalLinks", "externalLinks")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of either version, with ``snapshot_id`` (its file) and ``site_url``.

    A document that is broken, of another version, or without pages, site URL or a page's URL fails the read.
    """
    raw = spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path, multiLine=True)
    fail = lambda ok, why: F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(why)).cast("boolean"))
    site = F.coalesce("siteUrl", "startUrl", F.get("pages", F.lit(0))["url"])
    checked = (
        fail(F.col("schemaVersion").isin(1, 2), "unsupported snapshot schema version")
        & fail(F.col("pages").isNotNull(), "snapshot pages must be an array")
        & fail(site.isNotNull(), "snapshot site URL must be a string")
        & fail(F.forall("pages", lambda p: p["url"].isNotNull()), "page URL must be a string")
        & fail(F.col("sitemap").isNull() | F.col("sitemap.url").isNotNull(), "snapshot sitemap URL must be a string")
    )
    return raw.filter(checked).select(F.input_file_name().alias("snapshot_id"), site.alias("site_url"), "*")


def pages(snapshots: DataFrame) -> DataFrame:
    """One row per page with every default filled in; link lists are sorted."""
    rows = snapshots.select("snapshot_id", F.explode("pages").alias("p")).select("snapshot_id", "p.*")
    new = {c: F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)) for c in ZERO}
    new |= {c: F.coalesce(c, F.lit(False)) for c in NO}
    new |= {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in EMPTY}
    new |= {c: F.array_sort(F.coalesce(c, F.array().cast("array<string>"))) for c in SORTED}
    return rows.withColumns(new | {"canonicalRaw": F.coalesce("canonicalRaw", "canonical")})


def sitemap_urls(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("snapshot_id", F.explode("sitemap.urls").alias("url"))


def write_pages(page_table: DataFrame, path: str) -> None:
    """The page table as Parquet, one folder per snapshot."""
    page_table.write.mode("overwrite").partitionBy("snapshot_id").parquet(path)
