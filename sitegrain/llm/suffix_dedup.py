"""Removal of long repeated substrings with run-length indexes of aligned contexts.

Each string of ``length`` bytes has an anchor: the 32-byte piece of least hash in it, so equal strings have
equal anchors at equal places. The strings of one anchor, side by side, make its context. Anchors that occur
once are dropped; what is left are families of contexts around equal anchors, which are indexed on the cluster,
many families in a block and one block in a task at a time.

Index of a block (``RunIndex``). Contexts of a family lie side by side with their anchors in one column. The
Burrows-Wheeler transform of the contexts, with each byte taken together with its column, comes column by column
from the right: the bytes of a column in the order of the suffixes that follow them. A column is passed on as runs
(byte, length), with the suffix array sampled at both ends of each run. The LF step to the next column moves whole
runs. Statistics are streamed from runs and samples alone: inside a run a suffix keeps its neighbour and shares one byte
more with it; at run heads the neighbour is a sample. The matching statistic of a suffix is the longer of the prefixes
that it shares with its two neighbours; at ``length`` or more, the string that begins there is repeated and marked.

A context that occurs at several places enters the index as two rows, which stand for all. A family with one
context only is a single run in each column, whatever its bytes, so these need not be fetched. Families of more
than ``max_contexts`` different contexts would be too large for one task; in these, and only these, strings are
compared by digests, one key per string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Buckets, discard, fingerprint, fresh, lookup, materialise, materialise_table, sieved, small, text_or_empty, through
from .near_dedup import mix

LENGTH, PIECE = 400, 32
#: Passages: runs of repeated strings of this many bytes that hold more than so many words.
PASSAGE_LENGTH, PASSAGE_WORDS = 240, 50
#: Different contexts of one family that a task indexes at most.
MAX_CONTEXTS = 20_000
#: Bytes of texts whose anchors are searched at a time, rows of a block of families.
CHUNK, BLOCK_ROWS = 1 << 18, 2048

U = np.uint64
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_STEPS = [(1 << j, U(m)) for j, m in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))]
#: An odd factor and its inverse modulo 2**64, for hashes of any stretch of a buffer.
_FACTOR = 0xD1342543DE82EF95
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each window of w."""
    m = len(x) - w + 1
    blocks = np.concatenate([x, np.full(-len(x) % w, ~U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])


class Anchors:
    """Finds the anchors of many texts at a time."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.piece = min(PIECE, 1 << (length.bit_length() - 1))
        size = 2 * CHUNK + 2 * length
        with np.errstate(over="ignore"):
            self.powers, self.inverses = (np.cumprod(np.concatenate([[U(1)], np.full(size, U(f))])) for f in (_FACTOR, _INVERSE))

    def __call__(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(text's number, anchor, context, start, end, at) of all contexts; texts under ``length`` bytes have none."""
        segments, size = [], 0
        for i, data in enumerate(texts):
            for low in range(0, len(data) - self.length + 1, CHUNK):
                part = data[low : low + CHUNK + self.length - 1]
                if segments and size + len(part) > CHUNK:
                    yield self._buffer(segments)
                    segments, size = [], 0
                segments.append((i, low, part))
                size += len(part)
        if segments:
            yield self._buffer(segments)

    def _buffer(self, segments: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        owner, lows, parts = zip(*segments, strict=True)
        bytes_ = _BYTE[np.frombuffer(b"".join(parts), np.uint8)]
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        with np.errstate(over="ignore"):
            h = bytes_
            for step, factor in _STEPS:
                if step < self.piece:
                    h = h[:-step] * factor + h[step:]
            h = mix(h)
            least = _window_min((h & ~U(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64), self.length - self.piece + 1)
            at = (least & U(0xFFFFFF)).astype(np.int64)
            head = np.append(True, at[1:] != at[:-1])
            head[starts] = True
            valid = np.zeros(len(at) + 1, np.int8)
            valid[starts] += 1
            valid[ends - self.length + 1] -= 1
            inside = np.cumsum(valid[:-1]) > 0
            first = np.flatnonzero(head & inside)
            segment = np.searchsorted(starts, first, "right") - 1
            end = np.minimum(np.append(first[1:], len(at)) - 1, (ends - self.length)[segment]) + self.length
            at = at[first]
            sums = np.concatenate([[U(0)], np.cumsum(bytes_ * self.inverses[: len(bytes_)])])
            context = (sums[end] - sums[first]) * self.powers[first]
            context = mix(context ^ mix((at - first).astype(np.uint64) * U(0x9E3779B97F4A7C15) + (end - first).astype(np.uint64)))
        shift = (np.array(lows) - starts)[segment]
        return np.array(owner)[segment], h[at].view(np.int64), context.view(np.int64), first + shift, end + shift, at + shift


def _anchor_rows(length: int, distinct: bool):
    names = ["fp", "base", "anchor", "context", "start", "end", "at", "copies", "local"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in small(batches):
            # Equal pieces of a batch are gone through once.
            pieces: dict[tuple, list] = {}
            for fp, base, copies, data in zip(*(batch[c].to_pylist() for c in ("fp", "base", "copies", "data")), strict=True):
                known = pieces.setdefault((fp, base), [data, 0])
                known[1] = 1 if distinct else known[1] + copies
            keys, bases = pa.array([k[0] for k in pieces], pa.binary()), np.array([k[1] for k in pieces], np.int64)
            counts = np.array([v[1] for v in pieces.values()], np.int64)
            for owner, anchor, context, start, end, at in anchors([v[0] for v in pieces.values()]):
                order = np.lexsort((start, context, anchor, owner))
                owner, anchor, context, start, end, at = (x[order] for x in (owner, anchor, context, start, end, at))
                first = np.append(True, (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1]))
                times = np.diff(np.append(np.flatnonzero(first), len(first)))
                copies = np.zeros(len(first), np.int64)
                copies[first] = times * counts[owner[first]]
                # A later place of a context that its text has before: marked here, merged with those next to it.
                keep = np.flatnonzero(first)
                yield _place_batch(names, keys, bases, owner[keep], anchor[keep], context[keep], start[keep], end[keep], at[keep], copies[keep], False)
                rest = np.flatnonzero(~first)
                if len(rest):
                    spans: dict[int, list] = {}
                    for o, a, b in zip(owner[rest].tolist(), start[rest].tolist(), end[rest].tolist(), strict=True):
                        spans.setdefault(o, []).append((a, b))
                    rows = [(o, a, b) for o, s in spans.items() for a, b in merge_spans(s)]
                    own, a, b = (np.array(x) for x in zip(*rows, strict=True))
                    none = np.zeros(len(own), np.int64)
                    yield _place_batch(names, keys, bases, own, none, none, a, b, none, none, True)

    return run


def _place_batch(names, keys, bases, owner, anchor, context, start, end, at, copies, local) -> pa.RecordBatch:
    base = bases[owner]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), *map(pa.array, (base, anchor, context, start + base, end + base, at + base, copies)), pa.array(np.full(len(owner), local))], names=names)


class RunIndex:
    """Run-length index of families of contexts.

    ``contexts``: (family, bytes, place of the anchor), families together.
    """

    def __init__(self, contexts: list[tuple[int, bytes, int]]) -> None:
        families, data, places = zip(*contexts, strict=True)
        self.n = n = len(data)
        self.places, self.sizes = np.array(places), np.array([len(d) for d in data])
        self.zero = int(self.places.max())
        self.width = self.zero + int((self.sizes - self.places).max())
        rows = np.zeros((n, self.width), np.uint16)
        for row, (d, p) in enumerate(zip(data, places, strict=True)):
            rows[row, self.zero - p : self.zero - p + len(d)] = np.frombuffer(d, np.uint8)
            rows[row, self.zero - p : self.zero - p + len(d)] += 1
        self.columns = np.ascontiguousarray(rows.T)
        fams = np.array(families)
        self.border = np.append(True, fams[1:] != fams[:-1])
        self.family = np.cumsum(self.border) * 257

    def columns_of_runs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """The transform from the right, a column at a time, so that one is held.

        (column; bytes + 1 of its runs, 0 where there is no byte; their lengths; the suffix array sampled at both ends of
        each run; bytes that the first suffix of each run shares with the last one of the run before), the runs in the
        order that the LF step brings them into, which is that of the suffixes that begin in the column.
        """
        order, prefix = np.arange(self.n), np.zeros(self.n, np.int32)
        for column in range(self.width - 1, -1, -1):
            symbol = self.columns[column][order]
            head = self.border.copy()
            head[1:] |= symbol[1:] != symbol[:-1]
            start = np.flatnonzero(head)
            lengths = np.diff(np.append(start, self.n))
            key = self.family[start] + symbol[start]
            moved = np.argsort(key, kind="stable")
            runs = symbol[start[moved]], lengths[moved], order[start[moved]], order[(start + lengths - 1)[moved]]
            # LF: runs move as wholes. Inside a run neighbours stay neighbours and share one byte more.
            heads = np.cumsum(lengths[moved]) - lengths[moved]
            lf = np.repeat(start[moved] - heads, lengths[moved]) + np.arange(self.n)
            after = prefix[lf] + 1
            after[heads] = 0
            again = np.flatnonzero(key[moved][1:] == key[moved][:-1]) + 1
            if len(again):  # a run that now follows one of the same byte: the least prefix between the two, and this byte
                before, own = moved[again - 1], moved[again]
                least = np.minimum(_range_min(np.minimum.reduceat(prefix, start), before + 1, own), prefix[start[own]])
                after[heads[again]] = least + 1
            order, symbol = order[lf], symbol[lf]
            after[symbol == 0] = 0
            prefix = after
            yield column, *runs, prefix[heads]

    def matches(self, length: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each row and place in it: whether the string of ``length`` that begins there is also in another row, and, with ``rank``, whether in one of lower rank.

        Reads the runs and their samples only. A suffix's predecessor in the suffix array (phi) is the same as one
        column before, with one byte more in common, unless it heads a run: then it is the sample at the run's end before
        it. So a column changes as many entries as it has runs, and the statistics of all others follow from when they
        last changed.
        """
        found, later = np.zeros((self.width, self.n), bool), np.zeros((self.width, self.n), bool)
        before, common, since = np.arange(self.n) - 1, np.zeros(self.n, np.int64), np.full(self.n, self.width)
        for column, symbols, lengths, firsts, lasts, shared in self.columns_of_runs():
            before[firsts[1:]], before[firsts[0]] = lasts[:-1], -1
            common[firsts], since[firsts] = shared, column
            if not symbols.all():
                none = self.columns[column] == 0
                common[none], since[none] = 0, column
            if column + length > self.width:
                continue
            same = np.flatnonzero(common + since - column >= length)
            if not len(same):
                continue
            found[column, same] = found[column, before[same]] = True
            if rank is not None:  # of the suffixes that share the string, which phi links, the least rank
                to = np.arange(self.n)
                to[same] = before[same]
                while (further := to[to]).tobytes() != to.tobytes():
                    to = further
                least = rank.copy()
                np.minimum.at(least, to, rank)
                later[column] = found[column] & (rank > least[to])
        return found.T, later.T


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low:high] for each pair; all are of one or more values."""
    level = np.frexp((high - low).astype(float))[1] - 1
    out = np.empty(len(low), values.dtype)
    for k in range(int(level.max()) + 1):
        mine = level == k
        out[mine] = np.minimum(values[low[mine]], values[high[mine] - (1 << k)])
        if k < level.max():
            values = np.minimum(values[: -(1 << k)], values[1 << k :])
    return out


def _runs_of(marks: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each row of marks, the spans that strings of ``length`` from the marked places cover, those that overlap joined."""
    edges = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in marks]
    for (row, a), b in zip(np.argwhere(edges == 1).tolist(), np.argwhere(edges == -1)[:, 1].tolist(), strict=True):
        if out[row] and out[row][-1][1] >= a:
            out[row][-1] = (out[row][-1][0], b - 1 + length)
        else:
            out[row].append((a, b - 1 + length))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPANS = "array<struct<start:bigint,end:bigint>>"


def _span_array(spans: list) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS)


def _index(length: int, ranked: bool):
    """Rows (anchor, context, place, size, copies, owner, data), sorted by anchor, to (anchor, context, owner, found, later): spans from the context's start."""

    def verdicts(block: list[tuple]) -> pa.RecordBatch:
        out = []
        singles = [x for x in block if x[-1] is None]
        out += [(x[0], x[1], x[5], [(0, x[3])], []) for x in singles]
        block = [x for x in block if x[-1] is not None]
        if block:
            owners = {o: i for i, o in enumerate(sorted({x[5] for x in block}))}
            rows = [i for i, x in enumerate(block) for _ in range(min(2, x[4]))]
            index = RunIndex([(block[i][0], block[i][6], block[i][2]) for i in rows])
            found, later = index.matches(length, np.array([owners[block[i][5]] for i in rows]) if ranked else None)
            first = np.append(True, np.diff(rows) > 0)
            shifts = [index.zero - x[2] for x in block]
            for x, shift, a, b in zip(block, shifts, _runs_of(found[first], length), _runs_of(later[first], length), strict=True):
                if a:
                    out.append((x[0], x[1], x[5], [(s - shift, e - shift) for s, e in a], [(s - shift, e - shift) for s, e in b]))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), _span_array(columns[3]), _span_array(columns[4])], names=["anchor", "context", "owner", "found", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        for batch in small(batches):
            for row in zip(*(batch[c].to_pylist() for c in ("anchor", "context", "place", "size", "copies", "owner", "data")), strict=True):
                if len(block) >= BLOCK_ROWS and row[0] != block[-1][0]:
                    yield verdicts(block)
                    block = []
                block.append(row)
        yield verdicts(block)

    return run


def _strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for anchor, context, copies, owner, data in zip(*(batch[c].to_pylist() for c in ("anchor", "context", "copies", "owner", "data")), strict=True):
                n = len(data) - length + 1
                digests = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * n, pa.int64()), pa.array([context] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([copies] * n, pa.int64()), pa.array([owner] * n, pa.binary()), pa.array(digests, pa.binary())], names=["anchor", "context", "start", "copies", "owner", "digest"])

    return run


def merge_spans(spans) -> list[tuple[int, int]]:
    """Spans that overlap or touch, joined; in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *[b for _, b in spans]]
    return b"".join(data[a:b] for a, b in zip(ends, [*[a for a, _ in spans], len(data)], strict=True))


def place_key(fp: str, start: str) -> Column:
    """Bytes that order places by (fp, start)."""
    return F.concat(F.col(fp), F.unhex(F.lpad(F.hex(start), 16, "0")))


def _total(sizes: DataFrame) -> int:
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(data, requests) to the requests with their bytes."""
    for batch in small(batches):
        rows = [r | {"data": data[r["start"] : r["start"] + r["size"]]} for data, requests in zip(batch["data"].to_pylist(), batch["requests"].to_pylist(), strict=True) for r in requests]
        for a in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in _CONTEXT} for r in rows[a : a + 4096]], _CONTEXT)


_CONTEXT = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("copies", pa.int64()), ("owner", pa.binary()), ("large", pa.bool_()), ("data", pa.binary())])


def marks(pieces: DataFrame, length: int, keep_first: bool = False, max_contexts: int = MAX_CONTEXTS, texts: Buckets | None = None) -> tuple[DataFrame, Buckets]:
    """Where strings of ``length`` bytes in ``pieces`` are repeated.

    ``pieces``: (fp, base, copies, data), data being the bytes from ``base`` on of the text of that fingerprint;
    rows of equal (fp, base) are copies. ``texts``: (fp, data) of all texts that have pieces, bucketed by fp; by
    default the pieces are whole texts, and those that are involved are kept so. Returns (fp, spans) of all texts that
    have any, spans not joined, and the texts. With ``keep_first``, the place of least (fp, start) of each string is not
    in the spans.
    """
    found = materialise_table(through(pieces, _anchor_rows(length, keep_first), "fp binary, base long, anchor long, context long, start long, end long, at long, copies long, local boolean"))
    all_ = found.filter("not local")
    # With keep_first the rows of one text, found in several batches, count once.
    twice = (F.min("fp") != F.max("fp")) | (F.max("copies") > 1) if keep_first else F.sum("copies") > 1
    families = all_.groupBy("anchor").agg(twice.alias("twice"), (F.min("context") != F.max("context")).alias("mixed"), F.count("*").alias("n")).filter("twice").drop("twice")
    families = materialise_table(families)
    shared = materialise_table(lookup(all_.drop("local"), families.drop("n"), "anchor", families, _total(families)).filter("mixed is not null"))
    discard(families)
    place = F.struct("fp", "start", "base", "end", "at")
    kinds = materialise(shared.groupBy("anchor", "context").agg(F.when(twice, 2).otherwise(1).alias("copies"), F.first("mixed").alias("mixed"), F.min(place).alias("first"), F.count("*").alias("n")))
    large = materialise(kinds.filter("mixed").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > max_contexts).withColumn("large", F.lit(True)))
    any_large = _total(large)
    own = ["anchor", "context", (F.col("first.at") - F.col("first.start")).alias("place"), (F.col("first.end") - F.col("first.start")).alias("size"), "copies", place_key("first.fp", "first.start").alias("owner")]
    mixed = kinds.filter("mixed").drop("n")
    mixed = lookup(mixed, large.drop("n"), "anchor", large, any_large) if any_large else mixed.withColumn("large", F.lit(False))
    wanted = mixed.select(F.col("first.fp").alias("fp"), F.col("first.base").alias("base"), F.col("first.start").alias("start"), *own, F.coalesce("large", F.lit(False)).alias("large"))
    requests = wanted.groupBy("fp").agg(F.collect_list(F.struct("start", "anchor", "context", "place", "size", "copies", "owner", "large")).alias("requests"))
    local = materialise(found.filter("local").select("fp", "start", "end"))
    discard(found)
    if texts is None:
        # Where one occurrence stays, texts are read for their contexts only; else they are cut too.
        involved = materialise((wanted.select("fp") if keep_first else shared.select("fp").unionByName(local.select("fp"))).distinct())
        near = sieved(pieces.select("fp", "data"), involved, "fp", "maybe").filter("maybe")
        texts = Buckets(near.groupBy("fp").agg(F.first("data").alias("data")).join(involved, "fp", "left_semi"), "fp")
    columns = ["anchor", "context", "place", "size", "copies", "owner", "data"]
    asked = texts.table.join(requests, "fp").select("data", "requests")
    contexts = through(asked, _contexts, "anchor long, context long, place long, size long, copies long, owner binary, large boolean, data binary")
    single = kinds.filter("not mixed and copies > 1").select(*own, F.lit(None).cast("binary").alias("data"))
    indexed = contexts.filter("not large").select(columns).unionByName(single).repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "anchor").sortWithinPartitions("anchor")
    verdicts = through(indexed, _index(length, keep_first), f"anchor long, context long, owner binary, found {SPANS}, later {SPANS}")
    if any_large:
        # A string's anchor is a matter of the string, so strings of equal digests are of one family.
        strings = materialise_table(through(contexts.filter("large").select("anchor", "context", "copies", "owner", "data"), _strings(length), "anchor long, context long, start long, copies long, owner binary, digest binary"))
        same = materialise(strings.groupBy("digest").agg(F.sum("copies").alias("times"), F.min("owner").alias("least"), F.count("*").alias("n")).filter("times > 1").drop("times"))
        span = F.struct("start", (F.col("start") + length).alias("end"))
        repeated = lookup(strings, same.drop("n"), "digest", same, _total(same)).filter("least is not null")
        split = repeated.groupBy("anchor", "context").agg(F.first("owner").alias("owner"), F.collect_list(span).alias("found"), F.collect_list(F.when(F.col("owner") > F.col("least"), span)).alias("later"))
        verdicts = verdicts.unionByName(split)
    verdicts = materialise_table(verdicts)
    if any_large:
        discard(strings)
    # What holds for a context holds at each of its places; where one stays, that is the context's first.
    spans = F.when(place_key("fp", "start") == F.col("owner"), F.col("later")).otherwise(F.col("found")) if keep_first else F.col("found")
    moved = F.transform(spans, lambda s: F.struct((F.col("start") + s["start"]).alias("start"), (F.col("start") + s["end"]).alias("end")))
    marked = lookup(shared, verdicts, ["anchor", "context"], kinds, _total(kinds)).filter("owner is not null").select("fp", F.explode(moved).alias("m")).select("fp", "m.start", "m.end")
    marked = marked.unionByName(local.select("fp", "start", "end")).groupBy("fp").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return marked, texts


def _passages(least_words: int, length: int):
    """(fp, n, data, spans) to the passages, spans of over ``least_words`` words, and the stretches that can hold strings of ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            passages, stretches = [], []
            for data, spans in zip(batch["data"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                joined = merge_spans((s["start"], s["end"]) for s in spans)
                passages.append([(a, b) for a, b in joined if len(data[a:b].split()) > least_words])
                stretches.append([(a, b) for a, b in joined if b - a >= length])
            yield pa.RecordBatch.from_arrays([batch["fp"], batch["n"], _span_array(passages), _span_array(stretches)], names=["fp", "n", "passages", "stretches"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, n, data, stretches) to a row for each stretch."""
    for batch in small(batches):
        rows = [(fp, s["start"], n, data[s["start"] : s["end"]]) for fp, n, data, stretches in zip(*(batch[c].to_pylist() for c in ("fp", "n", "data", "stretches")), strict=True) for s in stretches]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["fp", "base", "copies", "data"])


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        spans, removed, digests = [], [], []
        for data, found in zip(batch["data"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            own = merge_spans((m["start"], m["end"]) for m in found)
            spans.append(own)
            removed.append(sum(b - a for a, b in own))
            digests.append(hashlib.sha256(cut(data, own)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch["fp"], _span_array(spans), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["fp", "spans", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", max_contexts: int = MAX_CONTEXTS, passage_length: int = PASSAGE_LENGTH, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per input row: the id, n_bytes, spans (array of start, end in bytes: what to remove), n_removed, n_spans, kept_sha256, passages.

    Removed is each byte that a string of ``length`` bytes covers which also begins at another place, in the same
    or another text; matches never cross texts and are judged on the input. ``passages`` are the stretches that
    strings of ``passage_length`` bytes (at most ``length``) cover in the same way, those of more than
    ``passage_words`` words; they are reported, not removed. The index is built for the shorter strings first; a
    longer repeated string can only lie inside a stretch of these, so the second index holds no other bytes.

    A null text is empty. Texts under ``length`` bytes lose nothing; of equal texts of that length, all bytes go in
    each. Null and repeated ids and rows are texts like any other; other columns are left out. An empty table
    gives no rows.
    """
    first = min(passage_length, length)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), fingerprint(text).alias("sha"), text.cast("binary").alias("data")).withColumn("fp", F.substring("sha", 1, 16))
    counts = materialise(rows.groupBy("fp").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    marked, texts = marks(rows.select("fp", F.lit(0).cast("long").alias("base"), F.lit(1).cast("long").alias("copies"), "data"), first, max_contexts=max_contexts)
    marked = texts.table.join(marked, "fp").join(counts, "fp").select("fp", "n", "data", "spans")
    passages = materialise_table(through(marked, _passages(passage_words, length), f"fp binary, n long, passages {SPANS}, stretches {SPANS}"))
    long_ones = texts.table.join(passages.filter(F.size("stretches") > 0), "fp").select("fp", "n", "data", "stretches")
    pieces = through(long_ones, _pieces, "fp binary, base long, copies long, data binary")
    longer, _ = marks(pieces, length, max_contexts=max_contexts, texts=texts)
    done = through(texts.table.join(longer, "fp").select("fp", "data", "spans"), _cutter, f"fp binary, spans {SPANS}, n_removed long, kept_sha256 string")
    table = materialise_table(passages.select("fp", "passages").join(done, "fp", "left"))
    texts.drop()
    out = lookup(rows.select(id_col, "n_bytes", "sha", "fp"), table, "fp", counts, total)
    nothing = F.array().cast(SPANS)
    spans = F.coalesce("spans", nothing)
    return out.select(id_col, "n_bytes", spans.alias("spans"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.size(spans).cast("long").alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"), F.coalesce("passages", nothing).alias("passages"))


def _clean(names: list[str], text_at: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, spans = batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            changed = []
            for i, marked in enumerate(spans):
                if marked:
                    data = texts[i].encode()
                    own = [(a, b) for a, b in merge_spans((s["start"], s["end"]) for s in marked) if len(data[a:b].split()) > least_words]
                    if own:
                        texts[i] = cut(data, own).decode(errors="ignore")
                        changed.append(i)
            flags = np.zeros(len(texts), bool)
            flags[changed] = True
            columns = [*batch.columns[:text_at], pa.array(texts, pa.string()), *batch.columns[text_at + 1 : -1], pa.array(flags)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def clean(docs: DataFrame, length: int = PASSAGE_LENGTH, least_words: int = PASSAGE_WORDS, text_col: str = "text", chars_col: str = "n_chars", max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``docs`` with one occurrence of each repeated passage: all others are cut out, and texts of which nothing is left go.

    A passage is a stretch that repeated strings of ``length`` bytes cover and that has more than ``least_words``
    words. Of the places of a string, the first stays, in order of (fingerprint of the text, place in it). Equal
    texts are one text here: copies of whole texts do not count as repeats, and are cut alike. Halves of
    characters at the cuts go too; ``chars_col``, where ``docs`` has it, follows the text. Texts without repeated
    passages stay as they are, null and empty ones included; other columns and all names stay.
    """
    fp, spans, flag = (fresh(docs, c) for c in ("fp", "spans", "cut"))
    text = text_or_empty(text_col)
    tagged = docs.withColumn(fp, F.substring(fingerprint(text), 1, 16))
    counts = materialise(tagged.groupBy(fp).agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pieces = tagged.select(F.col(fp).alias("fp"), F.lit(0).cast("long").alias("base"), F.lit(1).cast("long").alias("copies"), text.cast("binary").alias("data"))
    marked, texts = marks(pieces, length, True, max_contexts)
    table = materialise_table(marked.select(F.col("fp").alias(fp), F.col("spans").alias(spans)))
    texts.drop()
    # Texts without spans are not moved.
    maybe = fresh(tagged, "maybe")
    told = sieved(tagged, table, fp, maybe)
    joined = lookup(told.filter(maybe).drop(maybe), table, fp, counts, total)
    out = joined.unionAll(told.filter(~F.col(maybe)).drop(maybe).withColumn(spans, F.lit(None).cast(SPANS))).drop(fp)
    names = [*docs.columns, flag]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{flag}` boolean"
    made = through(out, _clean(names, docs.columns.index(text_col), least_words), kinds).filter(~F.col(flag) | (F.col(text_col) != ""))
    size = F.when(F.col(flag), F.length(text_col).cast("long")).otherwise(F.col(chars_col)) if chars_col in docs.columns else None
    return made.select(*[size.alias(c) if c == chars_col else c for c in docs.columns])


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    passage_bytes = F.aggregate("passages", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.size("passages").cast("long").alias("n_passages"), passage_bytes.alias("passage_bytes"))
