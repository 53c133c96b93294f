"""Near-duplicates by DartMinHash signatures of weighted word shingles and a banded join.

A text is the weighted set of its shingles of five words, weighted by how often they occur. Each shingle throws
darts, by hash, into the plane of weight and rank, which is divided into cells with one dart in the mean; darts
below the shingle's weight and a rank limit count, and of those that fall on a coordinate the one of least rank
is kept. Two texts agree in a coordinate with a probability of their weighted Jaccard similarity.

Equal texts are one node from the start. Nodes that share a band are candidates and are compared exactly, on
the shingles; buckets of the same members count once. A bucket of bounded size is gone through in one task:
members that already lie in one component are not compared again. In a larger bucket some members are pivots
and all others are compared with them, spread over tasks; the first pivot joins most of a group of copies, and
later ones are members outside the bucket's largest component, until each pair has been compared or lies in one
component. So no bucket is expanded into its pairs, none is cut, and no link between candidates is lost.
Components are found by contraction, on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import fingerprint, fresh, lookup, materialise, materialise_table, sieved, small, text_or_empty, through
from .decontaminate import split_words
from .tokens import slices

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of rows: at a similarity of 0.8, a pair shares a band with a probability of 0.999.
BANDS, ROWS = 30, 7
#: Members and bytes of a bucket that one task goes through.
BUCKET_NODES, BUCKET_BYTES = 4096, 8_000_000
#: Pivots of a larger bucket in its second round (twice as many in each later one); parts that a pivot's comparisons are spread over.
PIVOTS, PARTS = 64, 256
#: Characters, and cells of darts, that are worked on at a time.
SLICE, CELLS = 1 << 18, 1 << 18
#: Rows and columns of the blocks in which a bucket is compared.
ROW_BLOCK, COLUMN_BLOCK = 256, 1024

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes about half of the output's."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


class Shingler:
    """Weighted shingles of texts as 64-bit hashes. A text of fewer than five words, but one, is one shingle."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.known) > 150_000:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.known.get, words), np.uint64, len(words))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's number, shingle, weight), sorted by number and shingle."""
        split = [split_words(t) for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        words = self._hashes([w for part in split for w in part])
        with np.errstate(over="ignore"):
            h = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
            for j in range(SHINGLE):
                h = mix(h * U(31) + words[j : j + len(h)] + U(j + 1))
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), np.maximum(0, sizes - SHINGLE + 1))
        whole = [i for i, n in enumerate(sizes.tolist()) if n >= SHINGLE]
        starts = (ends - sizes)[whole]
        spans = np.maximum(0, sizes[whole] - SHINGLE + 1)
        at = np.repeat(starts - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))
        hashes = h[at] if len(at) else np.zeros(0, np.uint64)
        for i, n in enumerate(sizes.tolist()):
            if 0 < n < SHINGLE:
                with np.errstate(over="ignore"):
                    one = U(n)
                    for w in words[ends[i] - n : ends[i]]:
                        one = mix(np.array([one * U(37) + w]))[0]
                owner, hashes = np.append(owner, i), np.append(hashes, one)
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        first = np.flatnonzero(new)
        return owner[first], hashes[first], np.diff(np.append(first, len(owner)))


_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800, 39916800)])


def _darts(hashes: np.ndarray, weights: np.ndarray, reach: np.ndarray, k: int):
    """Darts below each element's weight and reach: (element, coordinate, rank, dart).

    Weights are divided into slabs [0, 1), [1, 2), [2, 4), ..., ranks in a slab of width w into steps of 1 / w:
    every cell has area 1 and a Poisson number of darts of mean 1, the same for all texts.
    """
    slabs = np.where(weights > 1, 2 + np.floor(np.log2(np.maximum(weights - 1, 1))).astype(np.int64), 1)
    element = np.repeat(np.arange(len(hashes)), slabs)
    slab = np.arange(len(element)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    width = np.where(slab > 0, 2.0 ** (slab - 1), 1.0)
    low = np.where(slab > 0, 2.0 ** (slab - 1), 0.0)
    steps = np.ceil(reach[element] * width).astype(np.int64)
    cell = np.repeat(np.arange(len(element)), steps)
    step = np.arange(len(cell)) - np.repeat(np.cumsum(steps) - steps, steps)
    seed = mix(hashes[element[cell]] + mix(slab[cell].astype(np.uint64) * U(0x9E3779B97F4A7C15) + step.astype(np.uint64) + U(1)))
    number = np.searchsorted(_POISSON, _unit(seed))
    dart_cell = np.repeat(np.arange(len(cell)), number)
    nth = np.arange(len(dart_cell)) - np.repeat(np.cumsum(number) - number, number)
    dart = mix(seed[dart_cell] + (nth.astype(np.uint64) + U(1)) * U(0xD1B54A32D192ED03))
    own = cell[dart_cell]
    rank = (step[dart_cell] + _unit(mix(dart + U(1)))) / width[own]
    weight = low[own] + _unit(mix(dart + U(2))) * width[own]
    hit = (weight < weights[element[own]]) & (rank < reach[element[own]])
    return element[own][hit], (mix(dart[hit] + U(3)) % U(k)).astype(np.int64), rank[hit], dart[hit]


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """n signatures of k darts; zeros for texts without shingles. Texts with an empty coordinate are thrown again with twice the reach."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weights, n)
    open_, aim = total > 0, k * (np.log(k) + 4)
    with np.errstate(over="ignore"):
        while open_.any():
            least = np.full(n * k, np.inf)
            mine = np.flatnonzero(open_[owner])
            # Short texts have many cells for each element: parts are cut by cells.
            cells = np.cumsum(np.ceil(aim / total[owner[mine]]) * 2 * weights[mine])
            for part in np.split(mine, np.flatnonzero(np.diff(cells // CELLS)) + 1):
                element, at, rank, dart = _darts(hashes[part], weights[part], aim / total[owner[part]], k)
                slot = owner[part][element] * k + at
                np.minimum.at(least, slot, rank)
                won = rank == least[slot]
                out.reshape(-1)[slot[won]] = dart[won]
            open_ &= np.isinf(least.reshape(n, k)).any(1)
            aim *= 2
    return out


def band_keys(signs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.zeros((len(signs), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
        for j in range(rows):
            keys = mix(keys * U(0x9E3779B97F4A7C15) + signs[:, j::rows][:, :bands])
    return keys.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in small(batches):
        # Equal texts of a batch are signed once.
        seen: dict[str, int] = {}
        texts, count, prints, firsts = [], [], [], []
        for text, fp, doc in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if text in seen:
                at = seen[text]
                count[at] += 1
                if doc is not None and (firsts[at] is None or doc < firsts[at]):
                    firsts[at] = doc
                continue
            seen[text] = len(texts)
            texts.append(text), count.append(1), prints.append(fp), firsts.append(doc)
        for a, b in slices(texts, SLICE):
            owner, hashes, weights = shingler(texts[a:b])
            keys = band_keys(signatures(owner, hashes, weights, b - a))
            some = np.bincount(owner, minlength=b - a) > 0
            bands = [row.tolist() if s else [] for row, s in zip(keys, some, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(prints[a:b], pa.binary()), pa.array(firsts[a:b], pa.int64()), pa.array(count[a:b], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["fp", "first", "n", "bands"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted shingles, weights); 0 if either is empty."""
    sums = int(a[1].sum()), int(b[1].sum())
    total = sum(sums)
    if not min(sums):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    both = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return both / (total - both)


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, pivot, of = Shingler(), None, None
        for batch in small(batches):
            a, b, sim = [], [], []
            for key, kind, node, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pivot", "kind", "node", "text")), strict=True):
                own = shingler([text])[1:]
                if kind == 0:
                    pivot, of = key, own
                elif pivot == key:
                    s = similarity(of, own)
                    if s >= least:
                        a.append(key), b.append(node), sim.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    return run


def compare(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Edges (a, b, similarity) of ``pairs`` (pivot, node) with a similarity of ``least`` or more.

    A pivot's members are spread over up to PARTS streams by hash; each begins with the pivot's text and holds one member at a time.
    """
    parts = pairs.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
    members = parts.join(texts, "node").select("pivot", "part", F.lit(1).alias("kind"), "node", "text")
    heads = parts.select("pivot", "part").distinct().join(texts.withColumnRenamed("node", "pivot"), "pivot").select("pivot", "part", F.lit(0).alias("kind"), F.col("pivot").alias("node"), "text")
    rows = members.unionByName(heads).repartition("pivot", "part").sortWithinPartitions("pivot", "part", "kind")
    return through(rows, _compare(least), EDGE)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b): root is the least node of the component.

    Each node points to its least neighbour, pointers are followed to their roots, and edges between roots are
    kept for the next contraction. All tables stay on the cluster. ``edges`` is a kept table: it is read twice.
    """
    n = edges.count()
    now = materialise(edges.select("a", "b").filter("a != b").distinct(), n)
    roots = None
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), 2 * n)
        while True:
            above = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = materialise(up.join(above, F.col("root") == F.col("_n")).select("node", F.col("_r").alias("root"), (F.col("root") != F.col("_r")).alias("moved")), 2 * n)
            up, moved = jumped.select("node", "root"), not jumped.filter("moved").isEmpty()
            if not moved:
                break
        if roots is None:
            roots = up
        else:
            above = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            roots = roots.join(above, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
        left, right = (up.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("a", "b"))
        now = materialise(now.join(left, "a").join(right, "b").filter("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), n)
    return roots if roots is not None else now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def forest(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, least: float) -> list[tuple[int, int, float]]:
    """Links (i, j, similarity) of ``least`` or more that join the same of n texts as all such links do.

    A shingle of weight w stands for w features, so texts have as many features in common as their shared weight.
    Features of one text only add nothing; the others make the columns of a 0/1 matrix, multiplied block by block.
    """
    total = np.bincount(owner, weights, n)
    nth = np.arange(int(weights.sum())) - np.repeat(np.cumsum(weights) - weights, weights)
    owner = np.repeat(owner, weights)
    with np.errstate(over="ignore"):
        _, feature, times = np.unique(mix(np.repeat(hashes, weights) + mix(nth.astype(np.uint64))), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    use = shared[feature]
    owner, column = owner[use], column[feature[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(shared.sum())
    out: list[tuple[int, int, float]] = []
    label = np.arange(n)
    for low in range(0, n, ROW_BLOCK):
        high = min(n, low + ROW_BLOCK)
        both = np.zeros((high - low, n), np.float32)
        for a in range(0, width, COLUMN_BLOCK):
            part = slice(*np.searchsorted(column, (a, a + COLUMN_BLOCK)))
            matrix = np.zeros((n, min(COLUMN_BLOCK, width - a)), np.float32)
            matrix[owner[part], column[part] - a] = 1
            both += matrix[low:high] @ matrix.T
        sim = both / np.maximum(total[low:high, None] + total[None, :] - both, 1)
        for i in range(low, high):
            near = np.flatnonzero(sim[i - low] >= least - 1e-6)
            near = near[(near != i) & (label[near] != label[i])]
            _, first = np.unique(label[near], return_index=True)
            for j in near[first].tolist():
                exact = int(both[i - low, j]) / (total[i] + total[j] - int(both[i - low, j]))
                if exact >= least and label[i] != label[j]:
                    out.append((i, j, exact))
                    label[label == label[j]] = label[i]
    return out


def _compare_bucket(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, band, nodes, texts = Shingler(), None, [], []

        def done():
            found = forest(*shingler(texts), len(texts), least) if len(texts) > 1 else []
            a, b, sim = zip(*found, strict=True) if found else ((), (), ())
            return [[nodes[i] for i in a], [nodes[i] for i in b], list(sim)]

        for batch in small(batches):
            out: list[list] = [[], [], []]
            for key, node, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("band", "node", "text")), strict=True):
                if key != band:
                    for column, more in zip(out, done(), strict=True):
                        column += more
                    band, nodes, texts = key, [], []
                nodes.append(node), texts.append(text)
            yield _edge_batch(out)
        yield _edge_batch(done())

    return run


def _edge_batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similarity"])


EDGE = "a long, b long, similarity double"


def linked(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(node, root) of all nodes that have a link. ``members``: (band, node) of all buckets of two or more."""
    n = members.count()
    sized = members.join(texts.select("node", F.octet_length("text").cast("long").alias("bytes")), "node")
    sets = sized.groupBy("band").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    small = (F.col("n") <= BUCKET_NODES) & (F.col("bytes") <= BUCKET_BYTES)
    buckets = materialise(sets.groupBy("n", "bytes", "x", "y").agg(F.min("band").alias("band")).select("band", small.alias("small")), n)
    rows = members.join(buckets.filter("small"), "band").join(texts, "node").select("band", "node", "text")
    edges = materialise(through(rows.repartition("band").sortWithinPartitions("band", "node"), _compare_bucket(least), EDGE))
    roots = components(edges)
    members = materialise(members.join(buckets.filter("not small"), "band").select("band", "node", F.lit(False).alias("used")), n)
    checked, most = None, PIVOTS
    while not members.isEmpty():
        placed = members.join(roots, "node", "left").select("band", "node", "used", F.coalesce("root", "node").alias("root"))
        if checked is None:
            pivots = members.groupBy("band").agg(F.min("node").alias("pivot"))
        else:
            nth = F.row_number().over(Window.partitionBy("band").orderBy("node"))
            largest = placed.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
            outside = placed.join(largest, "band").filter("not used and root != largest")
            most *= 2
            pivots = outside.withColumn("nth", nth).filter(F.col("nth") <= most).select("band", F.col("node").alias("pivot"))
        pivots = materialise(pivots, n)
        if pivots.isEmpty():
            break
        ends = placed.select("band", F.col("node").alias("pivot"), F.col("root").alias("_root")).join(pivots, ["band", "pivot"])
        pairs = placed.join(ends, "band").filter("root != _root").select(F.greatest("node", "pivot").alias("node"), F.least("node", "pivot").alias("pivot")).distinct()
        pairs = materialise(pairs if checked is None else pairs.join(checked, ["node", "pivot"], "left_anti"))
        found = materialise(compare(pairs, texts, least))
        edges = materialise(edges.unionByName(found), edges.count() + found.count())
        checked = pairs if checked is None else materialise(checked.unionByName(pairs), checked.count() + pairs.count())
        roots = components(edges)
        marks = pivots.select("band", F.col("pivot").alias("node"), F.lit(True).alias("now"))
        members = materialise(members.join(marks, ["band", "node"], "left").select("band", "node", (F.col("used") | F.coalesce("now", F.lit(False))).alias("used")), n)
    return roots


def nodes_and_roots(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``rows``: (fp, text, doc). Returns nodes (fp, node, first doc, n) and (node, root) of the linked ones."""
    signed = through(rows.select("fp", "text", "doc"), _sign, "fp binary, first long, n long, bands array<long>")
    nodes = materialise(signed.groupBy("fp").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    members = materialise(banded.join(shared, "band", "left_semi"))
    needed = materialise(members.select("node").distinct().join(nodes.select("node", "fp"), "node"))
    near = sieved(rows.select("fp", "text"), needed, "fp", "maybe").filter("maybe")
    texts = near.groupBy("fp").agg(F.first("text").alias("text")).join(needed, "fp").select("node", "text")
    return nodes, linked(members, materialise_table(texts), least)


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, class_id (least id of the class) and class_size (its rows).

    A class is a connected component of links between texts of a similarity of ``similarity`` or more. Words are
    runs of digits, letters (A-Z lower-cased) and non-ASCII characters. Equal texts are in one class, null and
    empty ones too; other texts without words are linked with none. The ids must be integers; null ids and
    repeated ids and rows stay, and a class of null ids only has a null class_id. Other columns are left out. An
    empty table gives no rows.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), fingerprint(text).alias("fp"))
    nodes, roots = nodes_and_roots(rows, similarity)
    placed = nodes.select("fp", "node", "first", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_class = placed.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    table = materialise(placed.join(per_class, "root").select("fp", "n", "class_id", "class_size"))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = lookup(rows.select("doc", "fp"), table.drop("n"), "fp", table.select("fp", "n"), total)
    return out.select(F.col("doc").alias(id_col), "class_id", "class_size")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (with doc_id and text) without near-duplicates: of each class one row stays, with the least doc_id (null ids last).

    Defined as ``classes``; of equal rows with that id, one stays. Other columns and all names stay.
    """
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text.alias("text"), fingerprint(text).alias("fp"))
    nodes, roots = nodes_and_roots(rows, similarity)
    placed = nodes.select("fp", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("first").isNull(), "first", "node")
    fp, own = fresh(docs, "fp"), fresh(docs, "own")
    name = lambda x: F.coalesce(x.cast("long").cast("string"), F.lit("none"))
    kept = placed.groupBy("root").agg(F.min_by(F.struct("fp", "first"), order).alias("k")).select(F.col("k.fp").alias(fp), name(F.col("k.first")).alias(own))
    # The id is part of the key: the rows of a large group of copies go to many tasks, and equal rows meet in one, where one of them stays.
    return docs.withColumn(fp, fingerprint(text)).withColumn(own, name(F.col("doc_id"))).join(kept, [fp, own]).dropDuplicates([fp, own]).select(*docs.columns)


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
