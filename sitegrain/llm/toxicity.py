"""Toxic passages by maximum-scoring segments of token log-odds.

Fit. A feature is a word, or a word's beginning with "*" (4 to 7 characters), so that forms of a word share
evidence. Its score is the log-odds of a toxic against another document, with an informative Dirichlet prior
in proportion to the feature's share of all documents; only features clearly on the toxic side are kept, and
any other word costs a fixed amount. From the scores of other documents' words come the parameters lambda and
K of the extreme-value law for segment scores, and a logistic curve maps the evidence of a document's
significant segments to a score; that part uses documents that the features were not learned from.

Scoring. Ruzzo and Tompa's linear scan finds all maximal scoring segments of a text. A segment of score S in a
text of n words has the normalised score lambda S - ln(K n); the positive ones add up to the evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small, text_or_empty, through

#: Labelled documents of either class that a model is fitted on at most; so its features are bounded by their words.
MAX_PER_CLASS = 20_000
#: Least documents of the toxic class with a feature, its least z-score and log-odds; weight of the prior in documents.
MIN_DOCS, MIN_Z, MIN_SCORE, PRIOR = 4, 3.0, 2.0, 50.0
#: Score of any other word; highest score of a feature.
OTHER, HIGHEST = -1.0, 6.0
BEGINNINGS = (7, 6, 5, 4)
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word, then its beginnings from long to short."""
    return [word, *[f"{word[:k]}*" for k in BEGINNINGS if len(word) > k]]


@dataclass
class Model:
    scores: dict[str, float]
    rate: float = 1.0  # lambda
    k: float = 0.1
    slope: float = 1.0
    intercept: float = -1.0

    def word_score(self, word: str) -> float:
        for f in features_of(word):
            if (s := self.scores.get(f)) is not None:
                return s
        return OTHER

    def evidence(self, text: str, cache: dict[str, float]) -> tuple[float, list[tuple[int, int, float]], float, int]:
        """Summed normalised scores, significant segments (first word, end, normalised score), best raw score, words."""
        values = []
        for w in _WORD.findall(text.lower()):
            if (s := cache.get(w)) is None:
                if len(cache) > 200_000:
                    cache.clear()
                s = cache[w] = self.word_score(w)
            values.append(s)
        segments = maximal_segments(values)
        floor = math.log(max(self.k * max(len(values), 1), 1e-9))
        found = [(a, b, e) for a, b, s in segments if (e := self.rate * s - floor) > 0]
        return sum(e for *_, e in found), found, max((s for *_, s in segments), default=0.0), len(values)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * evidence))))


def maximal_segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time; none for values without a positive one."""
    total, stack = 0.0, []  # stack: start, end, sum before, sum after, index of the nearest earlier one with a smaller sum before
    for i, v in enumerate(values):
        if v <= 0:
            total += v
            continue
        start, end, left = i, i + 1, total
        total += v
        right = total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def _fold(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def training_docs(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, toxic, fold) of labelled documents outside fold 0; at most MAX_PER_CLASS labels of a class, chosen by a hash of the id.

    Labels with a null id or class are left out; an id labelled twice counts as toxic if either label says so.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().withColumn("fold", _fold("id")).filter("fold != 0")
    known = known.groupBy("id", "fold").agg(F.max("toxic").alias("toxic"))
    picked = None
    for kind in (0, 1):
        part = known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(MAX_PER_CLASS)
        picked = part if picked is None else picked.unionByName(part)
    # Bounded: at most 2 * MAX_PER_CLASS rows of three numbers.
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(picked), "id").select("text", "toxic", "fold")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64())], names=["feature", "other", "toxic"])
        counts.clear()
        return out

    for batch in small(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for f in {f for w in set(_WORD.findall(text.lower())) for f in features_of(w)}:
                counts.setdefault(f, [0, 0])[toxic] += 1
            if len(counts) > 300_000:
                yield flush()
    yield flush()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model; without toxic or other labelled documents, one that scores every text below 0.5."""
    train = training_docs(docs, labels, id_col, text_col)
    first = train.filter("fold != 4").select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    n = {r[0]: r[1] for r in first.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model({})
    counts = through(first, _count, "feature string, other long, toxic long").groupBy("feature").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    prior = (F.col("toxic") + F.col("other")) / F.lit(n0 + n1) * F.lit(PRIOR)
    odds = lambda y, m: F.log((y + prior) / (F.lit(m + PRIOR) - y - prior))
    scored = counts.filter(F.col("toxic") >= MIN_DOCS).filter((F.col("toxic") + F.col("other")) < n0 + n1).withColumn("score", odds(F.col("toxic"), n1) - odds(F.col("other"), n0))
    z = F.col("score") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("other") + prior))
    top = scored.withColumn("z", z).filter((F.col("z") >= MIN_Z) & (F.col("score") >= MIN_SCORE))
    model = Model({r["feature"]: min(r["score"], HIGHEST) for r in top.select("feature", "score").collect()})
    held = train.filter("fold = 4").select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    _calibrate(model, held)
    return model


def _stats(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in small(batches):
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter(round(model.word_score(w), 1) for w in _WORD.findall(text.lower()))
                evidence, _, best, n = model.evidence(text, cache)
                rows.append({"toxic": toxic, "best": best, "n": n, "evidence": evidence, "values": list(words), "counts": list(words.values())})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("toxic", pa.int32()), ("best", pa.float64()), ("n", pa.int64()), ("evidence", pa.float64()), ("values", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64()))]))

    return run


def _calibrate(model: Model, held: DataFrame) -> None:
    """Sets lambda and K from other documents, then the logistic curve from both classes (bounded by the training sample)."""
    kinds = "toxic int, best double, n long, evidence double, values array<double>, counts array<long>"
    rows = through(held, _stats(model), kinds).collect()
    other = [r for r in rows if not r["toxic"] and r["n"]]
    seen = Counter()
    for r in other:
        seen.update(dict(zip(r["values"], r["counts"], strict=True)))
    total = sum(seen.values())
    if not total:
        return
    shares = {v: c / total for v, c in seen.items()}
    for v in {round(s, 1) for s in model.scores.values()}:
        shares.setdefault(v, 0.5 / total / max(1, len(model.scores)))
    model.rate = _rate(shares)
    gumbel = [model.rate * r["best"] - math.log(r["n"]) for r in other]
    model.k = math.exp(max(-12.0, sum(gumbel) / len(gumbel) - 0.5772))
    again = through(held, _stats(model), kinds).select("evidence", "toxic").collect()
    model.slope, model.intercept = _logistic(np.array([math.log1p(r["evidence"]) for r in again]), np.array([r["toxic"] for r in again], float))


def _rate(shares: dict[float, float]) -> float:
    """lambda > 0 with sum of share * exp(lambda * score) = 1; 1 if the mean score isn't negative or none is positive."""
    total = sum(shares.values())
    if sum(s * p for s, p in shares.items()) >= 0 or max(shares) <= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: sum(p / total * math.exp(x * s) for s, p in shares.items()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge; the slope is not below 0."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([0.05, 0.001])
        step = np.linalg.solve(hessian, design.T @ (y - p) - np.array([0.05, 0.001]) * w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), min(float(w[1]), -0.1)


def _scorer(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = broadcast.value, {}
        passage = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("evidence", pa.float64())])
        for batch in small(batches):
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                evidence, found, *_ = model.evidence(text, cache)
                scores.append(model.score(math.log1p(evidence)))
                passages.append([{"first_word": a, "end_word": b, "evidence": e} for a, b, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(passage))], names=["id", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, score (0 to 1) and passages (first word, end, evidence) that are significant.

    Null and empty texts have no passages and the lowest score. Null and repeated ids and rows stay; other
    columns are left out. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    made = through(rows, _scorer(shared), f"id {kind}, score double, passages array<struct<first_word:long,end_word:long,evidence:double>>")
    return made.withColumnRenamed("id", id_col)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
