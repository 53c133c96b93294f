"""Token ids in binary shards, with a minimal perfect hash index for access by key.

A store is a folder of three kinds of files:

* ``ids-*.bin``, the shards: the ids of many documents one after the other, little-endian, of two bytes where the
  vocabulary allows it and else of four; then where each document ends (64-bit), the keys (an Arrow stream) and a
  footer of fixed length. Shards follow one another in ascending order of keys.
* ``index-*.bin``: blocks of a minimal perfect hash function. A key's digest names its block; in the block, levels of
  bits are probed until one is set, and the number of bits set before it is the key's slot. The slot has a record of fixed
  length: fingerprint, shard, row of the first document with the key, how many there are. A key that the store does
  not hold is told by its fingerprint, but for one in 2**32.
* ``shards.arrow``, ``blocks.arrow``, ``manifest.json``: which files there are. Only what finished tasks wrote is named
  in them, so files of lost or repeated tasks are never read.

Access takes one probe of a block (of ``BLOCK_KEYS`` keys on average), one record, two ends, one read of ids. The
folder is opened by ``pyarrow.fs``: shared mounts, object stores and HDFS.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType, StringType

from .common import shared_path, small, text_or_empty, through
from .packing import END_ID
from .tokens import slices, tokenizer

#: Keys of an index block on average.
BLOCK_KEYS = 1 << 15
#: Bits of a level for each key that enters it.
SPACE = 2
#: Ids that are read at a time.
READ_IDS = 1 << 21
#: Documents of a shard that are fetched by one task at least, so that neighbours are read together.
NEAR = 64
FOOTER = "<8sQQQQ"
MAGIC = b"IDSHARD1"
RECORD = np.dtype([("print", "<u4"), ("shard", "<u4"), ("row", "<u8"), ("count", "<u8")])


def digest_of(key: int | str | None) -> bytes:
    return hashlib.md5(b"" if key is None else f"={key}".encode()).digest()


def _digest_column(key: Column) -> Column:
    """``digest_of`` as a column."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")).cast("binary")))


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each row of 16 bytes."""
    both = np.ascontiguousarray(digests).view("<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _prints(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, 12:]).view("<u4").ravel()


def _blocks(digests: np.ndarray, count: int) -> np.ndarray:
    return np.ascontiguousarray(digests[:, :4]).view(">u4").ravel().astype(np.int64) % count


def _rows(column: pa.Array) -> np.ndarray:
    """A binary column of 16 bytes each as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 16)


class PerfectHash:
    """A minimal perfect hash function: n different digests to the numbers 0 to n-1."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray) -> None:
        self.levels, self.bits = levels, bits
        ones = np.bitwise_count(bits).astype(np.uint64)
        self.ranks = np.cumsum(ones) - ones

    @staticmethod
    def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        """Where digests fall in a level of ``size`` bits: both halves are multiplied, folded and mixed."""
        with np.errstate(over="ignore"):
            x = first * np.uint64(2 * level + 0x9E3779B97F4A7C15 | 1) ^ second + np.uint64(level)
            x = (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
            return (x ^ x >> np.uint64(32)) % np.uint64(size)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        """A digest that falls on a bit alone sets it; the others go on to the next level."""
        first, second = _halves(digests)
        levels, bits = [], []
        while len(first):
            words = -(-len(first) * SPACE // 64)
            at = cls._place(first, second, len(levels), 64 * words)
            alone = np.bincount(at, minlength=64 * words) == 1
            levels.append(words)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            first, second = first[~alone[at]], second[~alone[at]]
            if len(levels) > 500:
                raise ValueError("two keys have the same digest")
        return cls(np.array(levels, np.uint64), np.concatenate([*bits, np.zeros(0, np.uint64)]))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where no level has its bit (never for a digest it was built with)."""
        first, second = _halves(digests)
        out, left, base = np.full(len(first), -1, np.int64), np.arange(len(first)), 0
        for level, words in enumerate(self.levels.tolist()):
            at = self._place(first[left], second[left], level, 64 * words)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + base, np.uint64(1) << (at & np.uint64(63))
            hit = self.bits[word] & bit != 0
            out[left[hit]] = (self.ranks[word[hit]] + np.bitwise_count(self.bits[word[hit]] & bit[hit] - np.uint64(1))).astype(np.int64)
            left, base = left[~hit], base + words
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.levels), len(self.bits)], "<u8").tobytes() + self.levels.astype("<u8").tobytes() + self.bits.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The function and the number of bytes that it took."""
        levels, words = np.frombuffer(data, "<u8", 2).tolist()
        numbers = np.frombuffer(data, "<u8", levels + words, 16)
        return cls(numbers[:levels], numbers[levels:]), 16 + 8 * (levels + words)


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(folder)


class TokenStore:
    """Reader of a store's files, in tasks and on the driver."""

    def __init__(self, folder: str) -> None:
        self.fs, self.base = _open(folder)
        with self.fs.open_input_file(f"{self.base}/manifest.json") as file:
            about = json.loads(file.read())
        self.width, self.docs, self.index_blocks = about["width"], about["docs"], about["blocks"]
        shards, blocks = self._table("shards"), self._table("blocks")
        self.files, self.sizes = shards["file"].to_pylist(), shards["docs"].to_numpy()
        self.starts = np.cumsum(shards["ids"].to_numpy()) - shards["ids"].to_numpy()
        self.block_files = dict(zip(blocks["block"].to_pylist(), zip(*(blocks[c].to_pylist() for c in ("file", "at", "bytes")), strict=True), strict=True))
        self._block = functools.lru_cache(4)(self._load_block)
        self._trailer = functools.lru_cache(2)(self._load_trailer)

    def _table(self, name: str) -> pa.Table:
        with self.fs.open_input_file(f"{self.base}/{name}.arrow") as file:
            return pa.ipc.open_file(file.read()).read_all()

    def _load_block(self, block: int) -> tuple[PerfectHash, np.ndarray]:
        if block not in self.block_files:
            return PerfectHash.build(np.zeros((0, 16), np.uint8)), np.zeros(0, RECORD)
        name, at, size = self.block_files[block]
        with self.fs.open_input_file(f"{self.base}/{name}") as file:
            data = file.read_at(size, at)
        function, used = PerfectHash.from_bytes(data)
        return function, np.frombuffer(data, RECORD, offset=used)

    def _load_trailer(self, shard: int) -> tuple[np.ndarray, pa.Array]:
        """Where each document of a shard begins (and the last one ends), and the keys."""
        with self.fs.open_input_file(f"{self.base}/{self.files[shard]}") as file:
            magic, width, docs, ends_at, keys_at = struct.unpack(FOOTER, file.read_at(struct.calcsize(FOOTER), file.size() - struct.calcsize(FOOTER)))
            if (magic, width, docs) != (MAGIC, self.width, self.sizes[shard]):
                raise ValueError(f"{self.files[shard]} is not the shard that the store names")
            ends = np.frombuffer(file.read_at(8 * docs, ends_at), "<i8")
            keys = pa.ipc.open_stream(file.read_at(file.size() - struct.calcsize(FOOTER) - keys_at, keys_at)).read_all().column(0).combine_chunks()
        return np.concatenate([[0], ends]), keys

    def find(self, block: int, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which digests of a block the store holds, the records of these)."""
        function, records = self._block(block)
        slots = function.slots(digests)
        held = slots >= 0
        held[held] = records["print"][slots[held]] == _prints(digests[held])
        return held, records[slots[held]]

    def extents(self, record: np.void) -> Iterator[tuple[int, int, int]]:
        """(shard, first row, number of rows) of a record's documents, which go on in later shards."""
        shard, row, left = int(record["shard"]), int(record["row"]), int(record["count"])
        while left:
            take = min(left, int(self.sizes[shard]) - row)
            if take:
                yield shard, row, take
            shard, row, left = shard + 1, 0, left - take

    def read(self, shard: int, row: int, count: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, ids before it in all of the store, its ids) for rows that follow one another."""
        begins, _ = self._trailer(shard)
        with self.fs.open_input_file(f"{self.base}/{self.files[shard]}") as file:
            while count:
                take = max(1, int(np.searchsorted(begins, begins[row] + READ_IDS, "right")) - 1 - row)
                take = min(take, count)
                a, b = int(begins[row]), int(begins[row + take])
                ids = np.frombuffer(file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}").astype("<u4")
                for i in range(row, row + take):
                    yield i, int(self.starts[shard] + begins[i]), ids[begins[i] - a : begins[i + 1] - a]
                row, count = row + take, count - take

    def get(self, key: int | str | None) -> list[np.ndarray]:
        """The ids of each document with the key, [] if there is none."""
        digest = np.frombuffer(digest_of(key), np.uint8).reshape(1, 16)
        if not self.index_blocks:
            return []
        _, records = self.find(int(_blocks(digest, self.index_blocks)[0]), digest)
        return [ids for record in records for extent in self.extents(record) for _, _, ids in self.read(*extent)]


def _shard_writer(folder: str, path: str, width: int, end_id: int, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        words, out, ends, keys, at = tokenizer(path), None, [], [], 0
        part = TaskContext.get().partitionId()
        name = f"ids-{part:05d}-{uuid.uuid4().hex}.bin"
        for batch in small(batches, 1024):
            out = out or fs.open_output_stream(f"{base}/{name}")
            keys.append(batch.column(0).cast(key_type))
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                found = words.encode_many(texts[a:b])
                out.write(np.concatenate([x for ids in found for x in (ids, [end_id])]).astype(f"<u{width}").tobytes())
                ends.append(at + np.cumsum([len(ids) + 1 for ids in found]))
                at = int(ends[-1][-1])
        if out is None:
            return
        ends = np.concatenate(ends).astype("<i8")
        out.write(ends.tobytes())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("key", key_type)])) as stream:
            stream.write_table(pa.table({"key": pa.chunked_array(keys, key_type)}))
        out.write(sink.getvalue())
        out.write(struct.pack(FOOTER, MAGIC, width, len(ends), at * width, at * width + 8 * len(ends)))
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name], "docs": pa.array([len(ends)], pa.int64()), "ids": pa.array([at], pa.int64())})

    return run


def _key_reader(folder: str):
    """Rows for shard numbers: each key with its first row in the shard and how many rows follow with the same key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = TokenStore(folder)
        for shard in (x for batch in batches for x in batch.column(0).to_pylist()):
            runs = store._trailer(shard)[1].to_pylist()
            firsts = [i for i, key in enumerate(runs) if not i or key != runs[i - 1]]
            counts = np.diff([*firsts, len(runs)])
            for a in range(0, len(firsts), 50_000):
                some = firsts[a : a + 50_000]
                yield pa.RecordBatch.from_pydict({"digest": [digest_of(runs[i]) for i in some], "shard": pa.array([shard] * len(some), pa.int64()), "row": pa.array(some, pa.int64()), "n": pa.array(counts[a : a + 50_000], pa.int64())})

    return run


def _index_writer(folder: str):
    """Writes the blocks of a task, whose rows come sorted by block, digest, shard and row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        name, out, at, held, written = f"index-{uuid.uuid4().hex}.bin", None, 0, [], []

        def write(block: int) -> None:
            nonlocal out, at
            digests, shards, rows, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.concatenate([[True], (digests[1:] != digests[:-1]).any(1)])
            firsts = np.flatnonzero(new)
            function = PerfectHash.build(digests[firsts])
            records = np.zeros(len(firsts), RECORD)
            slots = function.slots(digests[firsts])
            for column, values in (("print", _prints(digests[firsts])), ("shard", shards[firsts]), ("row", rows[firsts]), ("count", np.add.reduceat(counts, firsts))):
                records[column][slots] = values
            data = function.to_bytes() + records.tobytes()
            out = out or fs.open_output_stream(f"{base}/{name}")
            out.write(data)
            written.append({"block": block, "file": name, "at": at, "bytes": len(data), "keys": len(firsts)})
            at += len(data)
            held.clear()

        last = None
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if held and blocks[a] != last:
                        write(last)
                    last, part = int(blocks[a]), batch.slice(a, b - a)
                    held.append((_rows(part.column(1)), *(part.column(i).to_numpy() for i in (2, 3, 4))))
        if held:
            write(last)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist(written, pa.schema([("block", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("keys", pa.int64())]))

    return run


def _save(fs: pa.fs.FileSystem, path: str, table: pa.Table) -> None:
    with fs.open_output_stream(path) as out, pa.ipc.new_file(out, table.schema) as file:
        file.write_table(table)


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode whole texts, append the end id to each, and write them with their index to a folder that all executors share.

    Keys are integers or strings. Order: keys ascending, a null key first, documents with the same key by a hash of their
    text. A null text is an empty one and has the end id only. Repeated keys share one slot, and access gives all their
    documents; repeated rows are kept. A key that a third of all rows have is spread over shards. An empty table makes a
    store without shards. Columns other than the two are left out. The driver gets one row for each file and block.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (IntegralType, StringType)):
        raise TypeError(f"keys must be integers or strings, not {kind.simpleString()}")
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    from tokenizers import Tokenizer

    width = 2 if max(end_id + 1, Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)) <= 1 << 16 else 4
    key_type = pa.string() if isinstance(kind, StringType) else pa.int64()
    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    rows = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    shards = sorted(through(dealt, _shard_writer(folder, tokenizer_path, width, end_id, key_type), "part long, file string, docs long, ids long").collect())
    _save(fs, f"{base}/shards.arrow", pa.Table.from_pylist([r.asDict() for r in shards], pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])))
    docs_total = sum(r.docs for r in shards)
    count = -(-docs_total // BLOCK_KEYS)
    about = {"width": width, "end_id": end_id, "docs": docs_total, "blocks": count}

    def describe(blocks: list) -> None:
        _save(fs, f"{base}/blocks.arrow", pa.Table.from_pylist([r.asDict() for r in blocks], pa.schema([("block", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("keys", pa.int64())])))
        with fs.open_output_stream(f"{base}/manifest.json") as out:
            out.write(json.dumps(about).encode())

    describe([])
    if count:
        keys = through(spark.range(0, len(shards), 1, min(len(shards), 10_000)), _key_reader(folder), "digest binary, shard long, row long, n long")
        block = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % count
        entries = keys.select(block.alias("block"), "digest", "shard", "row", "n").repartition("block").sortWithinPartitions("block", "digest", "shard", "row")
        describe(through(entries, _index_writer(folder), "block long, file string, at long, bytes long, keys long").collect())


def locate(spark: SparkSession, folder: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """shard, row and n (rows that follow one another) of each different key that the store holds, by its index."""
    blocks = TokenStore(folder).index_blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = TokenStore(folder)
        for batch in batches:
            numbers, digests = batch.column(0).to_numpy(), _rows(batch.column(1))
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    found = [x for record in store.find(int(numbers[a]), digests[a:b])[1] for x in store.extents(record)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["shard", "row", "n"])

    digest = keys.select(_digest_column(F.col(key_col)).alias("digest")).distinct()
    block = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % max(1, blocks)
    asked = digest.select(block.alias("block"), "digest").repartition("block").sortWithinPartitions("block")
    return through(asked.filter(F.lit(blocks > 0)), run, "shard long, row long, n long")


def fetch(spark: SparkSession, folder: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """The documents of all given keys, read from the shards where the index says that they are.

    Returns key_col, start long (ids of all documents before it in the store), n_tokens long, ids binary (little-endian
    unsigned 32-bit), shard int. Keys that the store does not hold give no row, repeated ones the rows of one.
    """
    kind = keys.schema[key_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = TokenStore(folder)

        def batch_of(shard: int, got: list) -> pa.RecordBatch:
            names = store._trailer(shard)[1].take(pa.array([i for i, _, _ in got]))
            lengths = pa.array([len(ids) for _, _, ids in got], pa.int64())
            return pa.RecordBatch.from_arrays([names, pa.array([s for _, s, _ in got], pa.int64()), lengths, pa.array([ids.tobytes() for _, _, ids in got], pa.binary()), pa.array([shard] * len(got), pa.int32())], names=["key", "start", "n_tokens", "ids", "shard"])

        for batch in batches:
            spans: list[list[int]] = []
            for shard, row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if spans and spans[-1][0] == shard and spans[-1][1] + spans[-1][2] == row:
                    spans[-1][2] += n
                else:
                    spans.append([shard, row, n])
            for shard, row, n in spans:
                got, held = [], 0
                for x in store.read(shard, row, n):
                    got.append(x)
                    held += len(x[2])
                    if held > READ_IDS:
                        yield batch_of(shard, got)
                        got, held = [], 0
                if got:
                    yield batch_of(shard, got)

    dealt = locate(spark, folder, keys, key_col).repartition("shard", F.shiftright("row", NEAR.bit_length() - 1)).sortWithinPartitions("shard", "row")
    made = through(dealt, run, f"key {'string' if isinstance(kind, StringType) else 'long'}, start long, n_tokens long, ids binary, shard int")
    return made.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key_col)


def op11_token_index(spark, sf_dir: str) -> DataFrame:
    """Write all documents to a store in the shared folder (removed with the session) and read each back by its key."""
    import public_tokenizers

    path = shared_path(spark, "store")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_store(docs, path.toString(), public_tokenizers.path("word_bpe_49k.json"))
    return fetch(spark, path.toString(), docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "shard")
