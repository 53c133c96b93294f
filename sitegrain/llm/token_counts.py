"""Token counts that follow edits: a segment tree of pre-tokens per document.

A leaf is a pre-token: a run of blanks and the run of other characters after it. The tree keeps the characters
and tokens of each subtree. An edit finds its first and last leaf by characters, widens by one leaf on either
side as context, encodes only that stretch anew and updates the sums above it. New pre-tokens stay together in
the first leaf of the stretch; when one leaf has grown over ``SPLIT`` characters, the tree is built anew from
the leaves' texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small, text_or_empty, through
from .tokens import PIECE, WordTokenizer, slices, tokenizer as tokenizer_of

SPLIT = 4096
_LEAF = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


class CountTree:
    """Segment tree over the pre-tokens of one text. ``tokens`` is the text's count; ``encoded`` counts the leaves encoded so far."""

    def __init__(self, text: str, tokenizer: WordTokenizer, leaves: list[str] | None = None, counts: np.ndarray | None = None) -> None:
        """``leaves`` and ``counts``: the text's pre-tokens and their tokens, where the caller has them already."""
        if not tokenizer.by_words:
            raise ValueError("tokens that reach over blanks cannot be counted by pre-tokens")
        self.tokenizer = tokenizer
        self.encoded = 0
        self._build(leaves or _LEAF.findall(text) or [""], counts)

    def _build(self, leaves: list[str], counts: np.ndarray | None = None) -> None:
        self.leaves = leaves
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.counts = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        n = len(self.leaves)
        self.chars[self.size : self.size + n] = list(map(len, self.leaves))
        if counts is not None:
            self.counts[self.size : self.size + n] = counts
        for a, b in slices(self.leaves, PIECE) if counts is None else ():
            self.counts[self.size + a : self.size + b] = self._count(self.leaves[a:b])
        for tree in (self.chars, self.counts):
            level = self.size
            while level > 1:
                tree[level // 2 : level] = tree[level : 2 * level : 2] + tree[level + 1 : 2 * level : 2]
                level //= 2

    def _count(self, leaves: list[str]) -> np.ndarray:
        """Tokens of each leaf: its word's, as blanks have none."""
        self.encoded += len(leaves)
        return self.tokenizer.counts([x.strip(" \n") for x in leaves])

    @property
    def tokens(self) -> int:
        return int(self.counts[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf for the text's end), and where in it."""
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= int(self.chars[node])
                node += 1
        return node - self.size, at

    def _put(self, leaf: int, text: str, count: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.size
        more, tokens = len(text) - int(self.chars[node]), count - int(self.counts[node])
        while node:
            self.chars[node] += more
            self.counts[node] += tokens
            node //= 2

    def edit(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of characters start to end; both are cut to the text. Returns the text's tokens."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        first, inside = self._find(start)
        last, rest = self._find(end)
        low, high = first, last
        while low > 0 and (low == first or not self.leaves[low]):
            low -= 1
        while high < len(self.leaves) - 1 and (high == last or not self.leaves[high]):
            high += 1
        head = "".join(self.leaves[low:first]) + self.leaves[first][:inside]
        stretch = head + new + self.leaves[last][rest:] + "".join(self.leaves[last + 1 : high + 1])
        count = int(self._count(_LEAF.findall(stretch) or [""]).sum())
        for leaf in range(low + 1, high + 1):
            if self.leaves[leaf]:
                self._put(leaf, "", 0)
        self._put(low, stretch, count)
        if len(stretch) > SPLIT:
            self._build(_LEAF.findall(self.text()) or [""])
        return self.tokens


def _trees(texts: list[str], tokenizer: WordTokenizer) -> Iterator[CountTree]:
    """The trees of texts; short ones have their pre-tokens counted together."""
    for a, b in slices(texts, PIECE // 4):
        if b - a == 1:
            yield CountTree(texts[a], tokenizer)
            continue
        leaves = [_LEAF.findall(t) or [""] for t in texts[a:b]]
        counts = tokenizer.counts([x.strip(" \n") for one in leaves for x in one])
        at = 0
        for text, one in zip(texts[a:b], leaves, strict=True):
            yield CountTree(text, tokenizer, one, counts[at : at + len(one)])
            at += len(one)


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for batch in small(batches):
            rows = []
            texts = batch.column(1).to_pylist()
            for text, tree, edits in zip(texts, _trees(texts, tokenizer), batch.column(2).to_pylist(), strict=True):
                n, leaves = tree.tokens, len(tree.leaves) if text else 0
                tree.encoded = 0
                after = [tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in edits or [] if e]
                rows.append((n, leaves, after, tree.tokens, tree.length, tree.encoded))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["id", "n_tokens", "n_pretokens", "tokens_after", "n_tokens_edited", "n_chars_edited", "n_reencoded"])

    return run


EDITS = "array<struct<start:long,end:long,text:string>>"


def count_with_edits(docs: DataFrame, tokenizer_path: str, edits_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of each text before its edits, after each and after all.

    ``edits_col``: an array of (start, end, text) in code points of the text as edited so far, applied in order;
    positions are cut to the text, nulls are 0 and "", null edits are left out. Returns one row per input row:
    the id, n_tokens, n_pretokens, tokens_after (array), n_tokens_edited, n_chars_edited, n_reencoded (leaves
    that the edits had encoded anew). A null or empty text has no tokens; null and repeated ids and rows stay;
    other columns are left out. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.col(edits_col).cast(EDITS).alias("edits"))
    made = through(rows, _counter(tokenizer_path), f"id {kind}, n_tokens long, n_pretokens long, tokens_after array<long>, n_tokens_edited long, n_chars_edited long, n_reencoded long")
    return made.withColumnRenamed("id", id_col)


def standard_edits(text):
    """Fixed edits of the registered query: an insertion after a third, a cut in the middle, a replacement at the end."""
    n = F.length(text).cast("long")
    one = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), F.lit(new).alias("text"))
    third, half = F.floor(n / 3).cast("long"), F.floor(n / 2).cast("long")
    return F.array(one(third, third, " revised edition 2"), one(half, half + 25, ""), one(n - 10, n - 4, "Don't stop"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", standard_edits(text_or_empty()).alias("edits"))
    out = count_with_edits(docs, public_tokenizers.path("word_bpe_49k.json"), "edits")
    return out.select("doc_id", "n_tokens", "n_pretokens", F.get("tokens_after", F.lit(0)).alias("tokens_inserted"), F.get("tokens_after", F.lit(1)).alias("tokens_cut"), "n_tokens_edited", "n_chars_edited", "n_reencoded")
