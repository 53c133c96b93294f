"""Numbers of rows in a total order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.crawl import checkpointed


def with_rank(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``rows`` with their number (from 1) in ``order``; rows that tie are numbered in any order.

    Rows are dealt by ranges and sorted there; what is counted over all is one number for each partition.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_before")


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows each, with ``rank``."""
    return with_rank(rows, *order).filter(F.col("rank").between((number - 1) * size + 1, number * size))
