"""Sitemap indexes of many sites as tables: files by level, children that are new, limits for each site.

A site's files are taken like this: always the one of least URL among those known and not yet taken, the start first. Where a
file comes in that order needs no queue: along a path from the start, keep only the URLs that no later one
exceeds. These lists (``key``), compared element by element with the shorter first, are the order; a file that several indexes name has
its least key. So levels can be taken at once for all sites, and what is kept of a site is bounded by the limit of files: a
child's key is greater than its parent's, so files past the limit bring nothing before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.urls import is_crawlable, normalize, normalize_url, origin
from ..plans.crawl import checkpointed, shared_folder
from .sitemap import MAX_FILES, MAX_URLS, decode

READ = "file string, kind string, locs array<string>, error string"


def read_files(spark: SparkSession, path: str, url: Column) -> DataFrame:
    """(file, body) of a folder of sitemap files, plain or gzip; ``url`` gives a file's URL from the columns path, length and modificationTime."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(url.alias("file"), F.col("content").alias("body"))


def _read(body: bytes | None, file: str, include_query: bool) -> tuple[str | None, list[str], str | None]:
    """Kind, normalised URLs in their order, and what is wrong, of one file."""
    if body is None:
        return None, [], f"no sitemap at {file}"
    try:
        root = ElementTree.fromstring(decode(body, file.lower()))
    except (ValueError, OSError, ElementTree.ParseError, RecursionError) as e:
        return None, [], f"invalid sitemap at {file}: {type(e).__name__}"
    except Exception as e:  # zlib.error has no better base
        if type(e).__module__ != "zlib":
            raise
        return None, [], f"invalid sitemap at {file}: gzip"
    name = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    kind, entry = {"sitemapindex": ("index", "sitemap"), "urlset": ("urlset", "url")}.get(name(root), (None, None))
    if kind is None:
        return None, [], f"no sitemap at {file}"
    locs = []
    for child in root:
        found = [e for e in child if name(e) == "loc"] if name(child) == entry else []
        if len(found) == 1 and found[0].text and not len(found[0]):
            full = normalize(found[0].text.strip(), file, include_query=kind == "index" or include_query)
            if full:
                locs.append(full)
    return kind, locs, None


def parsed(files: DataFrame, include_query: bool = False) -> DataFrame:
    """(file, kind, locs, error) of (file, body), in place: bodies are not moved."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *_read(None if body is None else bytes(body), f, include_query)) for f, body in zip(b["file"], b["body"])]
            yield pd.DataFrame(rows, columns=["file", "kind", "locs", "error"])

    return files.filter("file is not null").select("file", "body").mapInPandas(run, READ)


def _first(rows: DataFrame, most: int) -> DataFrame:
    """(site, file, key, rank) of each site's first files, each file once with its least key."""
    least = rows.groupBy("site", "file").agg(F.min("key").alias("key"))
    return least.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("key"))).filter(F.col("rank") <= most)


def load(starts: DataFrame, files: DataFrame, max_files: int = MAX_FILES, max_urls: int = MAX_URLS, include_query: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sitemaps of all ``starts`` (site, file), whose files are in ``files`` (file, body; one row for each file).

    Returns (site, url): crawlable URLs of the site, each once, at most ``max_urls`` of a site in the order in which its files name
    them, and (site, sitemap_url, files, urls, truncated, error). One bad or missing file among those that are taken makes the
    site's sitemap an error without files and URLs. Children on another origin than the start are not followed. Each
    file is read once, where it lies; what moves between levels is at most ``max_files`` keys for each site.
    """
    spark = starts.sparkSession
    home = checkpointed(starts.filter("site is not null and file is not null").groupBy("site").agg(F.min("file").alias("start")))
    folder = shared_folder(spark, "sitemaps")
    parsed(files, include_query).write.partitionBy("kind").parquet(folder)
    read = spark.read.schema(READ).parquet(folder)
    edges = read.filter("kind = 'index'").select(F.col("file").alias("parent"), F.explode("locs").alias("file"))
    known = home.select("site", F.col("start").alias("file"), F.array().cast("array<string>").alias("key"))
    frontier = known
    while not frontier.isEmpty():
        found = frontier.withColumnRenamed("file", "parent").join(edges, "parent").join(home, "site").filter(origin(F.col("file")) == origin(F.col("start")))
        children = found.select("site", "file", F.concat(F.filter("key", lambda x: x > F.col("file")), F.array("file")).alias("key"))
        top = checkpointed(_first(known.unionByName(children), max_files).drop("rank"))
        frontier = checkpointed(top.join(known, ["site", "file", "key"], "left_anti"))  # new files, and those with a lesser key
        known = top
    return _listed(home, _first(known, max_files), read, max_files, max_urls)


def _listed(home: DataFrame, taken: DataFrame, read: DataFrame, max_files: int, max_urls: int) -> tuple[DataFrame, DataFrame]:
    """URLs and sums of the files taken, up to the file in which the limit of URLs is met."""
    locs = taken.join(read.filter("kind = 'urlset'"), "file").select("site", "rank", F.posexplode("locs").alias("pos", "url"))
    locs = locs.filter((origin(F.col("url")) == F.col("site")) & is_crawlable(F.col("url")))
    once = checkpointed(locs.groupBy("site", "url").agg(F.min(F.struct("rank", "pos")).alias("at")).select("site", "url", "at.rank", "at.pos"))
    counts = once.groupBy("site", "rank").agg(F.count("*").alias("n"))
    rows = taken.select("site", "file", "rank").join(read.select("file", "error", F.lit(True).alias("there")), "file", "left").join(counts, ["site", "rank"], "left")
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("site").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file: few
    rows = rows.withColumn("before", F.coalesce(so_far, F.lit(0))).filter(F.col("before") < max_urls)
    wrong = F.when(F.col("there").isNull(), F.concat(F.lit("no sitemap at "), "file")).otherwise(F.col("error"))
    sums = rows.groupBy("site").agg(F.count("*").alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("urls"), F.min(F.when(wrong.isNotNull(), F.struct("rank", wrong.alias("why")))).getField("why").alias("error"))
    rows, sums = checkpointed(rows.select("site", "rank", "before", "n")), checkpointed(sums)
    fine = F.col("error").isNull()
    state = home.join(sums, "site").select(
        "site", F.col("start").alias("sitemap_url"), F.when(fine, F.col("files")).otherwise(0).alias("files"), F.when(fine, F.least("urls", F.lit(max_urls))).otherwise(0).alias("urls"),
        (fine & ((F.col("files") >= max_files) | (F.col("urls") >= max_urls))).alias("truncated"), "error",
    )
    good = once.join(rows.filter("n > 0"), ["site", "rank"]).join(sums.filter(fine).select("site"), "site", "left_semi")
    over = F.col("before") + F.col("n") > max_urls
    nth = F.row_number().over(Window.partitionBy("site").orderBy("pos"))  # of the one file that is cut
    cut = good.filter(over).withColumn("nth", nth).filter(F.col("before") + F.col("nth") <= max_urls)
    return good.filter(~over).select("site", "url").unionByName(cut.select("site", "url")), state


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as sitemaps of their domains: a start, 24 indexes, up to 512 files (every other one packed); files of one ending are broken."""
    import gzip

    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", normalize_url(F.col("url")).alias("url")).filter("url is not null")
    site = F.concat(F.lit("https://"), F.regexp_extract("url", r"([^./]+\.[^./:]+)(?::\d+)?(/|$)", 1))
    p = raw.select(site.alias("site"), (F.col("page_id") % 512).alias("part"), F.concat(site, F.lit("/"), F.regexp_extract("url", "^https?://(.*)$", 1)).alias("url"))
    index = F.concat("site", F.lit("/maps/"), (F.col("part") % 24).cast("string"), F.lit(".xml"))
    leaf = F.concat("site", F.lit("/maps/"), (F.col("part") % 24).cast("string"), F.lit("-"), F.col("part").cast("string"), F.when(F.col("part") % 2 == 0, ".xml.gz").otherwise(".xml"))
    start = F.concat("site", F.lit("/sitemap.xml"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}><loc>"), c, F.lit(f"</loc></{name}>"))
    whole = lambda name, entries: F.concat(F.lit(f'<{name} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(entries, ""), F.lit(f"</{name}>"))
    parts = p.select("site", "part").distinct()
    broken = (F.col("part") % 7 == 3) & F.col("site").endswith(".net")
    leaves = p.groupBy("site", "part").agg(F.transform(F.array_sort(F.collect_list("url")), lambda u: tag("url", u)).alias("e")).select(leaf.alias("file"), whole("urlset", F.col("e")).alias("xml"), broken.alias("broken"))
    middle = parts.groupBy(index.alias("file")).agg(F.collect_set(tag("sitemap", leaf)).alias("e")).select("file", whole("sitemapindex", F.col("e")).alias("xml"), F.lit(False).alias("broken"))
    top = parts.groupBy(start.alias("file")).agg(F.collect_set(tag("sitemap", index)).alias("e")).select("file", whole("sitemapindex", F.col("e")).alias("xml"), F.lit(False).alias("broken"))

    @F.pandas_udf("binary")
    def body(file: pd.Series, xml: pd.Series, broken: pd.Series) -> pd.Series:
        plain = [(x[: len(x) // 2] if b else x).encode() for x, b in zip(xml, broken)]
        return pd.Series([gzip.compress(x, mtime=0) if f.endswith(".gz") else x for f, x in zip(file, plain)])

    path = shared_folder(spark, "sitemap-files")
    leaves.unionByName(middle).unionByName(top).select("file", body("file", "xml", "broken").alias("body")).write.parquet(path)
    urls, state = load(parts.select("site").distinct().select("site", start.alias("file")), spark.read.parquet(path))
    return state.join(urls, "site", "left").select("site", "url", "files", F.col("urls").alias("n_urls"), "truncated", "error")
