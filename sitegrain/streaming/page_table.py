"""A table of pages kept up to date from a stream of page logs: the last record of each URL counts.

Every batch is one folder, named by its number and overwritten when the batch is run again, so a restart changes
nothing. Readers take the latest base and the batches after it; ``compact`` makes a base of what there is, so the number
of folders that are read stays bounded. What a batch finds is read as it was before that batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


class KeyedTable:
    """Rows of which the one with the highest (order, batch) of each key counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: str, every: int = 16) -> None:
        self.spark, self.path, self.schema, self.keys, self.order, self.every = spark, path, schema, keys, order, every
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Finished folders of a kind."""
        top = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        found = [f.getPath() for f in self.fs.listStatus(top)] if self.fs.exists(top) else []
        return sorted(int(p.getName().split("=")[1]) for p in found if self.fs.exists(self.jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def last(self, rows: DataFrame) -> DataFrame:
        """One row for each key: an aggregation, so hot keys are combined before the shuffle."""
        rest = [c for c in rows.columns if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(self.order, "batch")).alias("r"))
        return best.select(*self.keys, *[F.col(f"r.{c}").alias(c) for c in rest])

    def _versions(self, before: int | None) -> DataFrame:
        base = max((n for n in self._numbers("base") if before is None or n < before), default=-1)
        deltas = [n for n in self._numbers("delta") if n > base and (before is None or n < before)]
        paths = ([f"{self.path}/base/batch={base}"] if base >= 0 else []) + [f"{self.path}/delta/batch={n}" for n in deltas]
        kind = f"{self.schema}, batch long"
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, before: int | None = None) -> DataFrame:
        """The current rows, or those before a batch."""
        return self.last(self._versions(before)).drop("batch")

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Add a batch; the same batch again takes the place of what it wrote before."""
        own = self.last(rows.withColumn("batch", F.lit(batch).cast("long")))
        own.write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")
        if batch % self.every == self.every - 1:
            self.compact(batch)

    def compact(self, batch: int) -> None:
        """A base of all rows up to a batch; older folders go when the next base is made, so that readers finish."""
        self.last(self._versions(batch + 1)).write.mode("overwrite").parquet(f"{self.path}/base/batch={batch}")
        older = [n for n in self._numbers("base") if n < batch]
        for kind, most in (("base", max(older, default=0)), ("delta", max(older, default=0) + 1)):
            for n in self._numbers(kind):
                if n < most:
                    self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/batch={n}"), True)


PAGE = "url string, status int, error string, seq long"


def parsed(lines: DataFrame) -> DataFrame:
    """Lines of page logs to (url, status, error, seq, broken); header lines and empty ones are left out, ``broken`` is a line that is no JSON."""
    kind = f"type string, page struct<{PAGE.replace(' ', ':').replace(',:', ',')}>, broken string"
    record = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = lines.filter("trim(value) != ''").select(record.alias("r"))
    return rows.filter("r.broken is not null or r.type = 'page'").select("r.page.*", "r.broken")


def follow(spark: SparkSession, log: str, path: str, checkpoint: str, files: int | None = None, also: Callable | None = None) -> list[dict]:
    """Take up what a log folder has now into the table at ``path``, a batch for each ``files`` files, and end.

    A second call goes on where this one ended or broke off. Broken lines, such as one that is still being
    written, are kept in ``path``/broken with their batch. Returns the progress of each batch that had rows: batch, rows, and
    rows a second. ``also`` is called with each batch's rows and number before these are in the table.
    """
    table = KeyedTable(spark, f"{path}/pages", PAGE, ["url"], "seq")

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        rows.filter("broken is not null").select("broken").write.mode("overwrite").parquet(f"{path}/broken/batch={number}")
        good = rows.filter("broken is null").drop("broken")
        if also:
            also(good, number)
        table.upsert(good, number)
        rows.unpersist()

    reader = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    query = parsed(reader.text(log)).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "per_second": p["processedRowsPerSecond"]} for p in query.recentProgress if p["numInputRows"]]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to a log in three waves, later ones with updates of old URLs; the table follows it in several batches, with a restart after each wave."""
    from ..functions.urls import normalize_url
    from ..plans.crawl import shared_folder
    from ..sources import checkpoint

    root, k = shared_folder(spark, "page-table"), F.col("page_id")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(normalize_url(F.col("url")).alias("url"), "page_id")
    for wave in range(3):
        status = F.when((k + wave) % 17 == 1, 503).when((k + wave) % 13 == 1, 404).otherwise(200)
        rows = p.filter(k % (wave + 1) == 0).select("url", status.alias("status"), F.when((k + wave) % 37 == 0, "timeout").alias("error"), (k + wave * 10_000_000).alias("seq"))
        checkpoint.append(rows.repartition(2), f"{root}/log")
        follow(spark, f"{root}/log", root, f"{root}/state", files=1)
    table = KeyedTable(spark, f"{root}/pages", PAGE, ["url"], "seq")
    return table.read().select("url", F.col("status").cast("long").alias("status"), "error", "seq")
