"""Page logs: one JSON line per page after a header line; the last line of a URL counts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import empty
from ..functions.urls import normalize_url

PAGE = "url string, status int, error string, seq long"
HEADER = "page-log"


def write_lines(identity: dict, pages: list[dict]) -> str:
    lines = [json.dumps({"type": HEADER, "schemaVersion": 2, "identity": identity}, sort_keys=True)]
    return "\n".join([*lines, *[json.dumps({"type": "page", "page": p}) for p in pages], ""])


def read_lines(text: str, identity: dict | None = None) -> list[dict]:
    """Pages of a log, last of each URL. A torn last line is left out, any other broken line is an error; so is another identity."""
    lines = text.split("\n")
    pages: dict[str, dict] = {}
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        try:
            record = json.loads(line)
        except ValueError:
            if i == len(lines) - 1:
                break
            raise ValueError(f"record {i + 1} is broken") from None
        if record.get("type") == "page":
            pages[record["page"]["url"]] = record["page"]
        elif identity is not None and record.get("identity") != identity:
            raise ValueError("the log belongs to another scan")
    return list(pages.values())


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(value, file_path, at, r) of all lines that are not blank; ``r.broken`` is a line that is no JSON."""
    kind = f"type string, page struct<{PAGE.replace(' ', ':').replace(',:', ',')}>, schemaVersion int, identity map<string,string>, source map<string,string>, broken string"
    lines = spark.read.text(path).select("value", "_metadata.file_path", F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("at")).filter("trim(value) != ''")
    return lines.withColumn("r", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))


def read_log(spark: SparkSession, path: str, identity: dict[str, str] | None = None, legacy: bool = False) -> DataFrame:
    """(url, status, error, seq) of all logs under ``path``; the last record of a URL is ``last_wins``.

    A torn last line of a file is left out; any other broken line is an error. Old logs (``legacy``) are read without
    any of their broken lines. With an ``identity`` (of a scan: names and texts), only files count whose first line is a header that says the
    same: version 2 with ``identity``, or version 1 with ``source`` if they are legacy logs. Files of other scans are left out,
    whatever is broken in them.
    """
    parsed = _records(spark, path)
    if identity is not None:
        version, field = (1, "source") if legacy else (2, "identity")
        heads = parsed.groupBy("file_path").agg(F.min_by("r", "at").alias("r"))
        said = F.sort_array(F.map_entries(f"r.{field}"))
        own = F.sort_array(F.map_entries(F.create_map(*[F.lit(x) for pair in identity.items() for x in pair]))) if identity else None
        same = (F.size(f"r.{field}") == 0) if own is None else (said == own)
        mine = heads.filter((F.col("r.type") == HEADER) & (F.col("r.schemaVersion") == version) & same).select("file_path")
        parsed = parsed.join(mine, "file_path", "left_semi")
    if not legacy:
        torn = parsed.filter("r.broken is not null").select("file_path", "at")
        last = parsed.groupBy("file_path").agg(F.max("at").alias("last"))
        if torn.join(last, "file_path").filter("at < last").head(1):
            raise ValueError(f"a record before the last one of a log under {path} is broken")
    return parsed.filter("r.broken is null and r.type = 'page' and r.page.url is not null").select("r.page.*")


def legacy_log_path(output: str) -> str:
    """Where the old log of a result file lies: its extension gives way to .checkpoint.ndjson."""
    folder, slash, name = output.rpartition("/")
    stem, dot, _ = name.rpartition(".")
    return f"{folder}{slash}{stem if dot and stem.strip('.') else name}.checkpoint.ndjson"


def append(pages: DataFrame, path: str) -> None:
    """Adds pages (url, status, error, seq) to the log folder, one file for each partition; what is there stays."""
    page = F.struct(*[F.col(c.split()[0]) for c in PAGE.split(", ")])
    pages.select(F.to_json(F.struct(F.lit("page").alias("type"), page.alias("page"))).alias("value")).write.mode("append").text(path)


def clear(spark: SparkSession, path: str) -> None:
    """Removes the log folder; nothing happens where there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def last_wins(pages: DataFrame) -> DataFrame:
    """The record of each URL with the highest seq: an aggregation, so nothing is sorted and hot URLs are combined early."""
    rest = [c for c in pages.columns if c != "url"]
    best = pages.groupBy("url").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return best.select("url", *[F.col(f"r.{c}").alias(c) for c in rest])


def reusable(pages: DataFrame) -> DataFrame:
    return pages.filter(empty(F.col("error")) & (F.coalesce("status", F.lit(200)) < 500))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    k = F.col("page_id")
    log = p.select(normalize_url(F.col("url")).alias("url"), F.when(k % 17 == 1, 503).when(k % 13 == 1, 404).otherwise(200).alias("status"), F.when(k % 37 == 0, "timeout").alias("error"), k.alias("seq"))
    from ..plans.crawl import shared_folder

    path = shared_folder(spark, "log")
    append(log, path)
    return reusable(last_wins(read_log(spark, path))).select("url", F.col("status").cast("long").alias("status"), "seq")
