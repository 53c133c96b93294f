"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Texts that are equal form one group, which must not be divided. Groups are dealt into cells of bounded
size by hash. In a cell, every group starts as a partial partition (its weight in one bin, the others
empty); the two partial partitions with the largest spread are combined again and again, the fullest bin
of one with the emptiest of the other, until one is left. The cells' partitions are the items of the next
level, and so on up to a single one. Labels are then passed down. No task holds more than ``cell_items``
items and the driver sees only counts.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import fingerprint, lookup, materialise, text_or_empty

#: Items that one task differences at most (on average; cells are filled by hash).
CELL_ITEMS = 20_000
#: Rows of one shard that are numbered together.
SLOT_ROWS = 20_000


def difference(items: list[list[int]], k: int) -> tuple[list[int], list[list[int]]]:
    """k-way differencing of items, each with up to k bin sums in falling order (rest 0).

    Returns the k sums in falling order and, for each item, the final bin of each of its bins. No items: k zeros.
    """
    if not items:
        return [0] * k, []
    nodes: list[tuple] = []
    heap = []
    for i, sums in enumerate(items):
        full = [*sums, *[0] * (k - len(sums))]
        nodes.append(())
        heap.append((full[-1] - full[0], i, full))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        raw = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(k), key=lambda j: -raw[j])
        sums = [raw[j] for j in order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (sums[-1] - sums[0], len(nodes) - 1, sums))
    _, root, total = heap[0]
    labels: list = [None] * len(nodes)
    labels[root] = list(range(k))
    for node in range(len(nodes) - 1, len(items) - 1, -1):
        a, b, order = nodes[node]
        own, left, right = labels[node], [0] * k, [0] * k
        for j, o in enumerate(order):
            left[o] = right[k - 1 - o] = own[j]
        labels[a], labels[b], labels[node] = left, right, None
    return total, labels[: len(items)]


def _solve(k: int):
    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        sums, labels = difference([list(map(int, x)) for x in pdf["sums"]], k)
        width = [len(x) for x in pdf["sums"]]
        here = pdf["cell"].iloc[0]
        rows = {"cell": [here] * (len(pdf) + 1), "item": [*pdf["item"], None], "bins": [*[x[:w] for x, w in zip(labels, width, strict=True)], sums]}
        return pd.DataFrame(rows)

    return cell


def balance(groups: DataFrame, n_shards: int, cell_items: int = CELL_ITEMS) -> DataFrame:
    """(group_key binary, weight long) to (group_key, shard int), byte-balanced. An empty table gives no rows."""
    n = groups.count()
    level = groups.select(F.col("group_key").alias("item"), F.array("weight").alias("sums"))
    levels: list[DataFrame] = []
    while True:
        cells = max(1, math.ceil(n / cell_items))
        key = F.pmod(F.xxhash64("item"), F.lit(cells)).cast("string").cast("binary")
        solved = materialise(level.withColumn("cell", key).groupBy("cell").applyInPandas(_solve(n_shards), "cell binary, item binary, bins array<long>"))
        levels.append(solved.filter("item is not null"))
        level, n = solved.filter("item is null").select(F.col("cell").alias("item"), F.col("bins").alias("sums")), cells
        if cells == 1:
            break
    top = levels.pop().select("item", "bins")
    while levels:
        down = levels.pop()
        above = top.select(F.col("item").alias("cell"), F.col("bins").alias("above"))
        top = down.join(above, "cell").select("item", F.transform("bins", lambda b: F.get("above", b.cast("int"))).alias("bins"))
    return top.select(F.col("item").alias("group_key"), F.get("bins", F.lit(0)).cast("int").alias("shard"))


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", cell_items: int = CELL_ITEMS) -> DataFrame:
    """Deal all documents to ``n_shards`` shards of near-equal bytes; equal texts stay together.

    Returns one row per input row: the id, size long (UTF-8 bytes plus 8), text_crc32 long, shard int, slot
    long (0, 1, ... without gaps in each shard). A null text counts as an empty one and belongs to the same
    group; null and repeated ids and repeated rows are rows like any other; other columns are left out. A
    group larger than a fair share fills its shard alone as far as possible. An empty table gives no rows.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), fingerprint(text).alias("group_key"))
    groups = materialise(rows.groupBy("group_key").agg(F.sum("size").alias("weight"), F.count("*").alias("n")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = balance(groups.select("group_key", "weight"), n_shards, cell_items)
    placed = lookup(rows, shards, "group_key", groups.select("group_key", "n"), total)
    chunks = max(1, math.ceil(total / (n_shards * SLOT_ROWS)))
    # The row number only spreads equal rows; once materialised it is the same for every reader.
    placed = materialise(placed.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks))))
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "chunk").orderBy(id_col, "group_key")
    return (
        placed.withColumn("place", F.row_number().over(within) - 1)
        .join(first, ["shard", "chunk"])
        .select(id_col, "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"))
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_documents(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
