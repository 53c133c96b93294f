"""Quality rules: divergence of a document's histograms from those of its language.

Two histograms per document: character classes, and common words of several languages with all other words as
one bin. A language's reference is the mean over all its documents that are long enough. A document is
rejected if the Jensen-Shannon distance (base 2, so 0 to 1) of either histogram from the reference exceeds its
limit; a histogram counts only in documents of a minimum length. The limit of words is a share of the distance
that a text with none of the common words has from the reference, so such texts are rejected wherever the list
covers the language. A language of few documents, or none given, has its characters held against the mean over all
documents, with letters of any script as one class, and its words, common or not, against the mean over its own.
The base rules reject texts of under 20 words or with over 30 % of words in repeated windows
of 8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, lookup, materialise, small, text_or_empty, through

#: Common words of English, French, German and Spanish.
COMMON = (
    "the of and to in a is that it for on with as are was be this by at from or an not "
    "le la les de des du et un une que qui dans en pour par sur est avec pas au "
    "der die das und ist den von zu mit auf im nicht ein eine dem sich auch "
    "el los las y del se una con su para como más lo al"
).split()
#: Limit of the distance of characters, and the words that a document must have for each histogram to count.
CHAR_LIMIT, CHAR_MIN_WORDS, WORD_MIN_WORDS = 0.3, 30, 100
#: Limit of the distance of words: a share of that of a text without common words, and the least limit, for languages that the list hardly covers.
WORD_SHARE, WORD_LEAST = 0.75, 0.25
#: Documents that a language must have for a reference of its own, and references that are broadcast at most; more are joined by shuffles.
MIN_DOCS, BROADCAST_LANGS = 20, 10_000
SYMBOLS, BLANKS, WINDOW = b"#*$%&|<>", b" \t\n\x0b\x0c\r", 8


def _class_table() -> np.ndarray:
    """Classes of bytes: lower, upper, digit, blank, line end, common punctuation, symbol, first byte of a 2-byte character, of a longer one; 9: left out."""
    table = np.full(256, 6, np.uint8)
    for k, chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:!?'\"()-"]):
        table[list(chars)] = k
    table[0xC0:0xE0], table[0xE0:], table[0x80:0xC0] = 7, 8, 9
    return table


CLASSES = _class_table()
N_CLASSES, LETTERS = 9, [0, 1, 7, 8]
COMMON_AT = {w.encode(): k for k, w in enumerate(COMMON)}
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of 8 that are found twice or more, first included."""
    if len(words) <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    n = len(words) - WINDOW + 1
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : j + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    left, right = order[:-1][same], order[1:][same]
    if not all((codes[left + j] == codes[right + j]).all() for j in range(WINDOW)):  # hashes that clash: count the windows themselves
        seen: dict[bytes, list[int]] = {}
        for i in range(n):
            seen.setdefault(codes[i : i + WINDOW].tobytes(), []).append(i)
        left = right = np.array([i for at in seen.values() if len(at) > 1 for i in at], np.int64)
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.union1d(left, right)
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return int((np.cumsum(edges) > 0).sum())


def _feature_batch(key: pa.Array, lang: pa.Array, texts: list[str]) -> pa.RecordBatch:
    rows = []
    for text in texts:
        data = text.encode()
        words = data.split()
        lines = [x for x in data.split(b"\n") if x.strip()]
        chars = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]
        hits = np.bincount(np.fromiter((k for w in data.lower().split() if (k := COMMON_AT.get(w.strip(b".,;:!?"))) is not None), np.int64), minlength=len(COMMON))
        rows.append((len(words), len(text) - len(data) + len(data.translate(None, BLANKS)), len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), chars.tolist(), [*hits.tolist(), len(words) - int(hits.sum())]))
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = [*[pa.int64()] * 5, pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([key, lang, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["key", "lang", *BASE, "chars", "words"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        yield _feature_batch(batch.column(0), batch.column(1), batch.column(2).to_pylist())


def _lang_key(lang: str = "lang") -> Column:
    """Bytes that stand for a language; none given has its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("")).cast("binary")


def references(features: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(_lang_key, _n, _reference) of every language, and the reference of all documents.

    A reference holds the mean histograms (characters, then words; in 1e-9) over the documents that are long
    enough, of which there are _n.
    """
    long = features.filter(F.col("n_words") >= WORD_MIN_WORDS).withColumn("_lang_key", _lang_key())
    shares = lambda col: F.transform(col, lambda x: F.round(x * F.lit(1e9) / F.greatest(F.lit(1), F.aggregate(col, F.lit(0), lambda a, b: a + b))).cast("long"))  # noqa: E731  whole numbers: sums don't depend on their order
    bins = long.select("_lang_key", F.posexplode(F.concat(shares(F.col("chars")), shares(F.col("words")))).alias("bin", "share"))
    sums = bins.groupBy("_lang_key", "bin").agg(F.sum("share").alias("share"), F.count("*").alias("_n"))
    means = F.sort_array(F.collect_list(F.struct("bin", F.round(F.col("share") / F.col("_n")).cast("int").alias("mean"))))
    table = materialise(sums.groupBy("_lang_key").agg(F.max("_n").alias("_n"), means.getField("mean").alias("_reference"), F.sort_array(F.collect_list(F.struct("bin", "share"))).getField("share").alias("sums")))
    pooled = np.zeros(N_CLASSES + len(COMMON) + 1)
    for r in table.select(F.posexplode("sums").alias("bin", "share")).groupBy("bin").agg(F.sum(F.col("share").cast("decimal(38,0)")).alias("share")).collect():
        pooled[r["bin"]] = float(r["share"])
    return table.drop("sums"), pooled


def with_references(rows: DataFrame, table: DataFrame, lang_col: str = "lang") -> tuple[DataFrame, str, str]:
    """``rows`` with how many documents are in the reference of their language and that reference, null where it has no document that is long enough, and the names of both columns, which ``rows`` did not have."""
    key, n, reference = (fresh(rows, c) for c in ("_lang_key", "_n", "_reference"))
    keyed, table = rows.withColumn(key, _lang_key(lang_col)), table.toDF(key, n, reference)
    if table.count() <= BROADCAST_LANGS:
        return keyed.join(F.broadcast(table), key, "left").drop(key), n, reference
    sizes = materialise(keyed.groupBy(key).agg(F.count("*").alias("n")))
    return lookup(keyed, table, key, sizes, sizes.agg(F.sum("n")).first()[0]).drop(key), n, reference


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of counts; 0 where either has none."""
    total = p.sum(-1, keepdims=True) * q.sum(-1, keepdims=True) > 0
    p, q = p / np.maximum(p.sum(-1, keepdims=True), 1e-300), q / np.maximum(q.sum(-1, keepdims=True), 1e-300)
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(-1)
    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1)) * total[..., 0]


def word_limit(words: np.ndarray) -> np.ndarray:
    """Limits of the distance of words from references (rows of word histograms)."""
    no_common = np.zeros(words.shape[-1])
    no_common[-1] = 1
    return np.maximum(WORD_LEAST, WORD_SHARE * distance(no_common, words))


def _merged(chars: np.ndarray) -> np.ndarray:
    """Histograms of characters with letters of any script as one class."""
    return np.concatenate([chars[..., LETTERS].sum(-1, keepdims=True), np.delete(chars, LETTERS, -1)], -1)


def _two(words: np.ndarray) -> np.ndarray:
    """Histograms of words as common ones and others."""
    return np.stack([words[..., :-1].sum(-1), words[..., -1]], -1)


def _verdicts(pooled: np.ndarray, features: pa.RecordBatch, n_docs: pa.Array, refs: pa.Array) -> pa.RecordBatch:
    get = lambda c: features.column(features.schema.get_field_index(c))
    n, repeat = get("n_words").to_numpy(), get("n_repeat_words").to_numpy()
    ref = np.zeros((len(n), len(pooled)))
    ref[refs.is_valid().to_numpy(zero_copy_only=False)] = refs.drop_null().flatten().to_numpy().reshape(-1, len(pooled))
    own = n_docs.fill_null(0).to_numpy(zero_copy_only=False) >= MIN_DOCS
    own &= get("lang").is_valid().to_numpy(zero_copy_only=False)
    chars = get("chars").flatten().to_numpy().reshape(-1, N_CLASSES).astype(float)
    words = get("words").flatten().to_numpy().reshape(-1, len(COMMON) + 1).astype(float)
    ref_words = ref[:, N_CLASSES:]
    char_d = np.where(own, distance(chars, ref[:, :N_CLASSES]), distance(_merged(chars), _merged(pooled[:N_CLASSES])))
    word_d = np.where(own, distance(words, ref_words), distance(_two(words), _two(ref_words)))
    limit = np.where(own, word_limit(ref_words), word_limit(_two(ref_words)))
    char_d, word_d = np.where(n >= CHAR_MIN_WORDS, char_d, 0.0), np.where(n >= WORD_MIN_WORDS, word_d, 0.0)
    failed = (n < 20) | (100 * repeat > 30 * n)
    kept = ~failed & (char_d <= CHAR_LIMIT) & (word_d <= limit)
    return pa.RecordBatch.from_arrays([*map(get, ["key", *BASE]), pa.array(failed), pa.array(char_d), pa.array(word_d), pa.array(kept)], names=["key", *BASE, "base_failed", "char_distance", "word_distance", "kept"])


def _judge(pooled: np.ndarray, n: str, reference: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield _verdicts(pooled, batch, batch[n], batch[reference])

    return run


def _keep(pooled: np.ndarray, columns: list[str], n: str, reference: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            features = _feature_batch(pa.nulls(len(texts)), batch["lang"].cast(pa.string()), texts)
            verdicts = _verdicts(pooled, features, batch[n], batch[reference])
            yield batch.select(columns).filter(verdicts["kept"])

    return run


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    A null or empty text has no words and fails the base rules. A document of a null or rare language (see
    MIN_DOCS) is held against all documents and its language's. Null and repeated ids and rows stay; other columns are left out. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("key"), F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text"))
    features = materialise(through(rows, _features, f"key {kind}, lang string, {COUNTS}, chars array<int>, words array<int>"))
    table, pooled = references(features)
    found, n, reference = with_references(features, table)
    judged = through(found, _judge(pooled, n, reference), f"key {kind}, {COUNTS}, base_failed boolean, char_distance double, word_distance double, kept boolean")
    return judged.withColumnRenamed("key", id_col)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with text and lang) that ``judge`` keeps; columns and nulls stay as they are."""
    rows = docs.select(F.lit(None).cast("long").alias("key"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    features = through(rows, _features, f"key long, lang string, {COUNTS}, chars array<int>, words array<int>")
    table, pooled = references(features)
    found, n, reference = with_references(docs, table)
    return through(found, _keep(pooled, docs.columns, n, reference), docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
