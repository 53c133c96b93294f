"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

#: A key that holds more than 1/HEAVY of all rows is handled apart, so at most HEAVY keys are ever broadcast.
HEAVY = 1000
#: Words of 64 bits of a sieve at most, which bounds what it broadcasts; and keys for each word below that.
SIEVE_WORDS, SIEVE_KEYS = 1 << 20, 4
#: Rows and bytes of a batch that goes to a Python worker at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
#: Rows of one partition of a kept table whose row count is known, and its least number of partitions.
PART_ROWS, LEAST_PARTS = 50_000, 16


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``; only where none is set and all runs on one machine (tests) make one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def through(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow``, with batches of bounded size and with workers that hand freed memory back to the system at a task's end.

    Lowers the session's limits on batches to ``BATCH`` where they are higher.
    """
    for key, most in BATCH.items():
        now = df.sparkSession.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            df.sparkSession.conf.set(key, most)

    def run(batches):
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def materialise(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation and rows are the same for each reader.

    ``rows``: as many as ``df`` has at most, where that is known and they are narrow. A small table is then kept in
    few files, not in one for each shuffle partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(LEAST_PARTS, rows // PART_ROWS + 1))
    return df.checkpoint(eager=True)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fingerprint(text: Column) -> Column:
    """32 bytes that stand for the whole text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], sizes: DataFrame, total: int) -> DataFrame:
    """Left join of ``rows`` with ``table`` (unique in ``key``, one column or several), safe for hot keys.

    ``sizes`` has the key and n, the number of rows of each key. The keys with over total/HEAVY rows, at
    most HEAVY of them, are broadcast with what the table has for them, if anything; their rows, and those without a
    key, get random-like keys in the shuffled join, where what they match is not used, so no task receives a hot key.
    """
    keys = [key] if isinstance(key, str) else key
    extra = [c for c in table.columns if c not in keys]
    mark = "_lookup"
    while any(c.lower().startswith(mark) for c in [*rows.columns, *table.columns]):
        mark += "_"
    hot_value, is_hot, value, spread = (f"{mark}_{x}" for x in ("hot", "is", "cold", "spread"))
    cold_keys = [f"{mark}_key{i}" for i in range(len(keys))]
    hot = sizes.filter(F.col("n") > max(1, total // HEAVY)).select(keys)
    held = table.join(F.broadcast(hot), keys, "left_semi").select(*keys, F.struct(*extra).alias(hot_value))
    hot_table = hot.join(F.broadcast(held), keys, "left").withColumn(is_hot, F.lit(True))
    cold = table.select(*[F.col(k).alias(c) for k, c in zip(keys, cold_keys, strict=True)], F.struct(*extra).alias(value))
    number = F.monotonically_increasing_id()
    kind = rows.schema[keys[0]].dataType
    other = F.xxhash64(number).cast(kind) if isinstance(kind, IntegralType) else F.sha2(number.cast("string"), 256).cast(kind)
    tagged = rows.join(F.broadcast(hot_table), keys, "left").withColumn(spread, F.when(F.col(is_hot).isNotNull() | F.col(keys[0]).isNull(), other).otherwise(F.col(keys[0])))
    same = [F.col(k) == F.col(c) for k, c in zip([spread, *keys[1:]], cold_keys, strict=True)]
    got = F.when(F.col(is_hot).isNotNull(), F.col(hot_value)).when(F.col(keys[0]).isNotNull(), F.col(value))
    return tagged.join(cold, same, "left").select(*rows.columns, got.alias(value)).select(*rows.columns, *[F.col(f"{value}.{c}").alias(c) for c in extra])


def sieved(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a boolean column that is false only where ``key`` is not among ``keys`` (a kept table with that column).

    A filter of one bit for each key's hash, its words broadcast: rows that cannot match are told before a shuffle. Beyond
    ``SIEVE_KEYS * SIEVE_WORDS`` keys it lets more pass; it never holds back a row that matches.
    """
    words = min(SIEVE_WORDS, keys.count() // SIEVE_KEYS + 1)
    at, bits = fresh(rows, f"{name}_at"), fresh(rows, f"{name}_bits")
    place = f"pmod(xxhash64(`{key}`), {64 * words}L)"
    bit = F.expr(f"shiftleft(1L, cast({place} & 63 as int))")
    table = materialise(keys.select(F.expr(f"shiftright({place}, 6)").alias(at), bit.alias(bits)).groupBy(at).agg(F.bit_or(bits).alias(bits)), words)
    tagged = rows.withColumn(at, F.expr(f"shiftright({place}, 6)")).join(F.broadcast(table), at, "left")
    return tagged.select(*rows.columns, (F.coalesce(F.col(bits), F.lit(0).cast("long")).bitwiseAND(bit) != 0).alias(name))


def shared_path(spark: SparkSession, kind: str):
    """A new Hadoop path in the shared folder, removed when the session ends."""
    ensure_checkpoint_dir(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4()}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path


class Buckets:
    """A table in the shared folder that is bucketed by key columns, so that joins on these do not move its rows.

    As many buckets as shuffle partitions now; what it is joined with is dealt alike.
    """

    def __init__(self, df: DataFrame, *keys: str) -> None:
        self.spark, self.name, self.path = df.sparkSession, f"buckets_{uuid.uuid4().hex}", shared_path(df.sparkSession, "buckets")
        self.count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(self.count, *keys).sortBy(*keys).format("parquet").option("path", self.path.toString()).saveAsTable(self.name)

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Remove the table and its files; nothing may read it any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(self.path, True)


def materialise_table(df: DataFrame) -> DataFrame:
    """Like ``materialise`` for wide rows: a compressed table in the shared folder, removed when the session ends."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "table")
    df.write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


def discard(table: DataFrame) -> None:
    """Remove the files of a ``materialise_table`` that nothing reads any more."""
    files = table.inputFiles()
    if files:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(batches, rows: int = 256):
    """The batches in slices, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
