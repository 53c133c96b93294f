"""Packing by power-of-two decomposition: sequences of equal power-of-two lengths, none across documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small, text_or_empty, through
from .tokens import slices, tokenizer

#: Tokens of the longest sequence; a power of two.
MAX_LENGTH = 4096
#: The id that ends each document.
END_ID = 2


def binary_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two that add up to n, in falling order, none over ``longest``."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packer(path: str, longest: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for batch in small(batches, 1024):
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                owner, start, length, tokens, flat = [], [], [], [], []
                for i, ids in zip(range(a, b), words.encode_many(texts[a:b]), strict=True):
                    flat += [ids, np.array([end_id], np.uint32)]
                    at, n = 0, len(ids) + 1
                    for size in binary_lengths(n, longest):
                        owner.append(i), start.append(at), length.append(size), tokens.append(n)
                        at += size
                data = np.concatenate(flat).astype("<u4")
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.int64()), pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])],
                    names=["id", "start", "length", "doc_tokens", "ids"],
                )

    return run


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = MAX_LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids (and the end id) into pieces of power-of-two length; each piece is a sequence.

    Returns one row per piece: the document's id, start, length, doc_tokens, ids (binary: little-endian
    unsigned 32-bit ids), bucket int (the length's exponent; equal lengths make batches without padding; see
    ``write_buckets``), sequence_id long (different for each piece), offset long (0). A null or empty text is
    one piece with the end id. Null and repeated ids and repeated rows are packed like any other; other columns
    are left out. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    made = through(rows, _packer(tokenizer_path, max_length, end_id), f"id {kind}, start long, length long, doc_tokens long, ids binary")
    bucket = F.round(F.log2("length")).cast("int").alias("bucket")
    return made.select(F.col("id").alias(id_col), "start", "length", "doc_tokens", "ids", bucket, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per length, so that batches of equal length are read from one place."""
    packed.write.partitionBy("bucket").parquet(path)


def digest(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return packed.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack(docs, public_tokenizers.path("word_bpe_49k.json")))
