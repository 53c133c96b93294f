"""How the sources of each language differ in their terms: pairs of sources, and the terms that mark a source.

Terms are counted inside tasks, for each language and source, and summed by a shuffle on language and term, so that a
source with a third of all rows sends no more than its vocabulary from each task. A language keeps the terms of enough of
its documents. Kept counts are cut into blocks of terms; in a block, each source has a compressed vector (places and
counts), also where it has none of the block's terms.

Pairs by systolic rotation. The seats of a language, one for each source, play a round-robin tournament in each block:
in a round every source meets one other, and after as many rounds as there are other sources all have met. The
vectors of all seats stay where they are, in one table bucketed by language, block and seat; of each meeting's two, one
travels to the other (home and away alternate, so that seats host alike). A meeting is evaluated once and gives
both directions. A few rounds are one job, and their sums are kept before the next begin, so what travels at a time does
not grow with the number of sources. Sums over blocks are the pair's value.

Terms are ranked in each block, against the language's own counts, by a heap for each source; only the heaps' terms go on.

Chances are integers, computed by long division, exact below 9 * 10**15 terms of a source and language.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Buckets, lookup, materialise, through

#: Documents of a language that a kept term is in at least.
MIN_DOCS = 30
#: What each count is raised by.
PRIOR = 5
#: Terms that are listed for a source.
TOP = 50
#: Counts of one block on average.
BLOCK_CELLS = 1 << 18
#: Rounds of the tournaments in one job.
ROUNDS = 8
#: Different terms that a task counts before it sends them on; bytes of a text that are split at a time.
HELD_TERMS, PIECE = 200_000, 1 << 22
#: Each byte as it counts in a term: A-Z lower-cased, other letters and all beyond ASCII as they are, the rest a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    start = 0
    while start < len(text):
        piece = text[start : start + PIECE].translate(FOLD)
        if start + len(piece) < len(text):
            cut = piece.rfind(b" ") + 1
            while not cut:  # a term of more than a piece
                more = text[start + len(piece) : start + len(piece) + PIECE].translate(FOLD)
                piece += more
                cut = len(piece) if start + len(piece) >= len(text) else piece.rfind(b" ") + 1
            piece = piece[:cut]
        yield piece.split()
        start += len(piece)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def give() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            terms = list(counts)
            for a in range(0, len(terms), 50_000):
                some = terms[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for terms in terms_of(text):
                counts.update(terms)
                own.update(terms)
            docs.update(own)
        if sum(len(counts) for counts, _ in held.values()) > HELD_TERMS:
            yield from give()
    yield from give()


def chances(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + PRIOR) / (total + PRIOR * kept)) of each count."""
    whole, rest, out = total + PRIOR * kept, counts + PRIOR, np.zeros(len(counts), np.int64)
    if whole >= 9 * 10**15:
        raise ValueError("too many terms for exact chances")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def compress(places: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes() + counts.astype("<i8").tobytes(), 1)


def expand(vector: bytes | None, size: int) -> np.ndarray:
    """All counts of a block of ``size`` terms."""
    out = np.zeros(size, np.int64)
    if vector is not None:
        data = zlib.decompress(vector)
        n = len(data) // 12
        out[np.cumsum(np.frombuffer(data, "<u4", n).astype(np.int64))] = np.frombuffer(data, "<i8", n, 4 * n)
    return out


SEATS = "lang string, block long, seat long, seats long, source string, total long, kept long, size long, vector binary, item string, value long"


def _seats(top: int):
    """From a block's sources (rows without a term) and its counts, sorted by term: the seats with their vectors, and each source's heap of terms."""
    schema = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("seat", pa.int64()), ("seats", pa.int64()), ("source", pa.string()), ("total", pa.int64()), ("kept", pa.int64()), ("size", pa.int64()), ("vector", pa.binary()), ("item", pa.string()), ("value", pa.int64())])

    def block_of(key: tuple, heads: list[dict], cells: list[pa.RecordBatch]) -> Iterator[dict]:
        lang, block = key
        empty = np.zeros(0, np.int64)
        if cells:
            table = pa.Table.from_batches(cells)
            terms, sources = table["term"].combine_chunks(), table["source"].combine_chunks().dictionary_encode()
            runs = terms.dictionary_encode()
            places, names, codes, counts = runs.indices.to_numpy(), runs.dictionary, sources.indices.to_numpy(), table["n"].to_numpy()
            by_source = {s: np.flatnonzero(codes == i) for i, s in enumerate(sources.dictionary.to_pylist())}
        else:
            places = counts = empty
            names, by_source = pa.array([], pa.string()), {}
        size = len(names)
        of_lang = np.zeros(size, np.int64)
        np.add.at(of_lang, places, counts)
        usual = chances(of_lang, heads[0]["lang_total"], heads[0]["kept"]) if size else empty
        for head in heads:
            own = by_source.get(head["source"], empty)
            row = {"lang": lang, "block": block, "source": head["source"]}
            yield row | {"seat": head["seat"], "seats": head["seats"], "total": head["total"], "kept": head["kept"], "size": size, "vector": compress(places[own], counts[own]) if len(own) else None}
            if len(own):
                more = chances(counts[own], head["total"], head["kept"]) - usual[places[own]]
                above = np.flatnonzero(more > 0)
                for value, place in heapq.nsmallest(top, zip((-more[above]).tolist(), places[own][above].tolist(), strict=True)):
                    yield row | {"item": names[place].as_py(), "value": -value}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, cells, out = None, [], [], []

        def over() -> Iterator[pa.RecordBatch]:
            for row in block_of(now, heads, cells) if heads else ():
                out.append(row)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()

        for batch in batches:
            langs, blocks = batch.column("lang").to_pylist(), batch.column("block").to_pylist()
            a = 0
            for b in range(1, len(langs) + 1):
                if b < len(langs) and langs[b] == langs[a] and blocks[b] == blocks[a]:
                    continue
                if (langs[a], blocks[a]) != now:
                    yield from over()
                    now, heads, cells = (langs[a], blocks[a]), [], []
                part = batch.slice(a, b - a)
                first = part.column("term").null_count  # nulls come first
                heads += part.slice(0, first).select(["source", "seat", "seats", "total", "kept", "lang_total"]).to_pylist()
                if first < part.num_rows:
                    cells.append(part.slice(first).select(["term", "source", "n"]))
                a = b
        yield from over()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of differences of each meeting, in both directions. A host's chances are kept for its next visitor."""
    host, own = None, None
    for batch in batches:
        rows = []
        for lang, block, seat, source, total, kept, size, vector, other, other_total, other_vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            value = 0
            if size:
                if host != (lang, block, seat):
                    host, own = (lang, block, seat), chances(expand(vector, size), total, kept)
                value = int(np.abs(own - chances(expand(other_vector, size), other_total, kept)).sum())
            rows += [(lang, source, other, value), (lang, other, source, value)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.string(), pa.int64())], names=["lang", "source", "item", "value"])


def opponent(seat, seats, round_):
    """Whom a seat meets in a round of the circle method (columns or numbers; an odd number of seats has an empty one)."""
    even = seats + seats % 2
    ring = even - 1
    other = (round_ - seat + ring) % ring
    last = round_ * (even // 2 if isinstance(even, int) else F.floor(even / 2)) % ring
    if isinstance(seat, int):
        return last if seat == ring else ring if other == seat else other
    return F.when(seat == ring, last).when(other == seat, ring).otherwise(other).cast("long")


def _rounds(seats: DataFrame, first: int, count: int) -> DataFrame:
    """Values, by block, of the meetings of some rounds: one of the two vectors travels to the other's seat."""
    even = F.col("seats") + F.col("seats") % 2
    rounds = F.explode(F.expr(f"sequence({first}L, {first + count - 1}L)")).alias("round")
    there = opponent(F.col("seat"), F.col("seats"), F.col("round"))
    moving = seats.select("lang", "block", "seat", "seats", "source", "total", "vector", rounds).filter(F.col("round") < even - 1).withColumn("host", there)
    away = (F.col("seat") < F.col("host")) == ((F.col("seat") + F.col("host")) % 2 == 0)
    guests = moving.filter((F.col("host") < F.col("seats")) & away).select("lang", "block", F.col("host").alias("seat"), F.col("source").alias("other"), F.col("total").alias("other_total"), F.col("vector").alias("other_vector"))
    met = seats.select("lang", "block", "seat", "source", "total", "kept", "size", "vector").join(guests, ["lang", "block", "seat"]).select("lang", "block", "seat", "source", "total", "kept", "size", "vector", "other", "other_total", "other_vector")
    values = through(met, _meet, "lang string, source string, item string, value long")
    return values.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, block_cells: int = BLOCK_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """lang, source, part (pair or term), item, value long, rank int: see the module and the contract of its query.

    Null languages, sources and texts are empty strings; they are groups like others. A row is a document, so repeated
    rows count each time. Ties of value are ranked by item (by bytes). A language without kept terms has pairs of value 0
    and no terms; one with a single source has no pairs. An empty table gives no rows. Other columns are left out.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = through(rows, _count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    cells = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    one = Window.partitionBy("lang", "term")
    kept = cells.withColumn("all_docs", F.sum("docs").over(one)).withColumn("first", F.row_number().over(one.orderBy("source")) == 1)
    kept = materialise(kept.filter(F.col("all_docs") >= min_docs).select("lang", "term", "source", "n", "first"))
    groups = rows.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = materialise(groups.select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total")))
    of_lang = groups.groupBy("lang").agg(F.count("*").alias("seats"), F.sum("total").alias("lang_total"))
    sizes = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("kept"), F.count("*").alias("n"))
    langs = of_lang.join(sizes, "lang", "left").select("lang", "seats", "lang_total", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    langs = materialise(langs.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / block_cells))))
    total, most = langs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("seats"), F.lit(0))).first()
    dealt = lookup(kept, langs.select("lang", "blocks"), "lang", langs.select("lang", "n"), total)
    counts = dealt.select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n", *(F.lit(None).cast("long").alias(c) for c in ("seat", "seats", "total", "kept", "lang_total")))
    by_name = Window.partitionBy("lang").orderBy("source")
    heads = groups.withColumn("seat", F.row_number().over(by_name).cast("long") - 1).join(langs, "lang")
    heads = heads.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"), "seat", "seats", "total", "kept", "lang_total")
    in_blocks = heads.unionAll(counts).repartition("lang", "block").sortWithinPartitions("lang", "block", F.col("term").asc_nulls_first(), "source")
    made = materialise(through(in_blocks, _seats(top), SEATS))
    seats = Buckets(made.filter(F.col("seat").isNotNull()).drop("item", "value").repartition("lang", "block", "seat"), "lang", "block", "seat")
    pairs = None
    for first in range(0, max(1, most + most % 2 - 1), rounds):
        played = materialise(_rounds(seats.table, first, rounds))
        pairs = played if pairs is None else pairs.unionAll(played)
    seats.drop()
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    both = []
    for part, values in (("pair", pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))), ("term", made.filter(F.col("item").isNotNull()))):
        placed = values.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
        both.append(placed.filter(F.col("rank") <= top) if part == "term" else placed)
    return both[0].unionAll(both[1])


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
    SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
    SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), g AS (
    SELECT DISTINCT lang, source FROM d
), c AS (
    SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL
), dense AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, count(*) OVER (PARTITION BY g.lang, g.source) AS v
    FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
    SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS p FROM dense
), whole AS (
    SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total, count(*) OVER (PARTITION BY lang) AS v FROM dense GROUP BY lang, term
), q AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS q FROM whole
), met AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
), terms AS (
    SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
