"""A page log as a stream: rules that need only the page itself, and counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def row_rules(pages: DataFrame) -> DataFrame:
    """Stateless: works on streams in append mode as on tables. ``pages``: url, status, error."""
    status = F.coalesce("status", F.lit(500))
    rule = F.when(F.coalesce("error", F.lit("")) != "", F.when(F.contains("error", F.lit("redirect loop")), "redirect-loop").otherwise("page-unreachable")).when(status >= 400, "http-error")
    return pages.withColumn("rule", rule).filter("rule is not null").select("url", "rule")


def counts_by_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events per minute and type; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that is there now to ``path`` and ends; a second call goes on where this one stopped."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream, event by event, into a table."""
    from ..plans.crawl import shared_folder

    root = shared_folder(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    kept = stream.filter("event_type is not null").select("event_id", "user_id", "event_type", F.round("value", 2).alias("value"))
    run_available(kept, f"{root}/out", f"{root}/state")
    return spark.read.schema(kept.schema).parquet(f"{root}/out")
