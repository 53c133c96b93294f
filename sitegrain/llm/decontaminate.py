"""Benchmark decontamination with a generalised suffix automaton of the items' words.

The automaton holds all word sequences of the items. A document is streamed through it word by word, keeping
the length of the longest match that ends at each word; a match of the window's length (or of a whole shorter
item) marks its words and names the items. Stretches that cannot hold a window, because too few adjacent word
pairs in a row occur in items, are passed over first.

The automaton is built on the driver from at most ``block_words`` words at a time and sent out as arrays. Items
beyond that make further blocks, each matched against all documents in a pass of its own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, small, text_or_empty, through

WINDOW = 10
#: Words of the items in one automaton: its size bound (see ``Automaton.freeze``).
BLOCK_WORDS = 250_000

#: Bytes to words: A-Z to lower case, digits, letters and all non-ASCII bytes stay, others are blanks.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window.

    ``items``: (item_id, words). A window is ``window`` consecutive words of an item, or the whole of a shorter
    one; items without words have none. Windows of an item whose id is null are hit like others.
    """

    def __init__(self, items: list[tuple], window: int = WINDOW) -> None:
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.whole: dict[int, set] = {}  # state of a short item's whole: ids
        self.holds: dict[int, set] = {}  # state whose strings include a window's: ids
        self.least = window
        coded = [(item, [self.words.setdefault(w, len(self.words)) for w in words]) for item, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        for item, codes in coded:
            if len(codes) < window:
                self.least = min(self.least, len(codes))
                state = self._walk(codes)
                self.whole.setdefault(state, set()).add((len(codes), item))
            else:
                for end in range(window, len(codes) + 1):
                    self.holds.setdefault(self._cut(self._walk(codes[end - window : end])), set()).add(item)
        pairs = {(a, b) for _, codes in coded for a, b in zip(codes, codes[1:], strict=False)}
        self.pairs = np.array(sorted((a << 32) | b for a, b in pairs), np.int64)
        self.above = self._marked_above()
        self.freeze()

    def freeze(self) -> None:
        """From one dict for each state to arrays of its only transition, and dicts for the few states that branch.

        Measured: about 200 bytes a word of the items (at most two states a word), and 830 while it is built.
        """
        self.symbol, self.target = (array("i", [-1]) * len(self.next) for _ in range(2))
        self.branches: dict[int, dict[int, int]] = {}
        for state, ways in enumerate(self.next):
            if len(ways) == 1:
                ((self.symbol[state], self.target[state]),) = ways.items()
            elif ways:
                self.branches[state] = ways
        named: dict[frozenset, frozenset] = {}  # one object for windows of the same items
        self.holds = {state: named.setdefault(own := frozenset(ids), own) for state, ids in self.holds.items()}
        self.link, self.len, self.above = array("i", self.link), array("i", self.len), array("i", self.above)
        del self.next

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.len[q] == self.len[last] + 1:
                return q
            return self._clone(last, q, c)
        new = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        clone = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _walk(self, codes: list[int]) -> int:
        state = 0
        for c in codes:
            state = self.next[state][c]
        return state

    def _stream(self, codes) -> Iterator[tuple[int, int]]:
        state = length = 0
        symbol, target, branches, link, lens = self.symbol, self.target, self.branches, self.link, self.len
        none: dict[int, int] = {}
        for c in codes:
            while True:
                to = target[state] if symbol[state] == c else branches.get(state, none).get(c, -1)
                if to >= 0:
                    state, length = to, length + 1
                    break
                if not state:
                    length = 0
                    break
                state = link[state]
                length = lens[state]
            yield state, length

    def _cut(self, state: int) -> int:
        """The state of the match's last ``window`` words."""
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _marked_above(self) -> list[int]:
        """For each state, itself or the nearest suffix state that is the whole of a short item; -1 for none."""
        out = [-1] * len(self.len)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            out[s] = s if s in self.whole else out[self.link[s]]
        return out

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words (start, end; joined, in order) and the ids of the items with occurring windows."""
        spans: list[list[int]] = []
        found: set = set()
        for a, b in self._stretches(words):
            at = a
            for state, length in self._stream([self.words[w] for w in words[a:b]]):
                at += 1
                mark = []
                if length >= self.window:
                    mark.append(self.window)
                    found |= self.holds.get(self._cut(state), frozenset())
                s = self.above[state]
                while s > 0:
                    for size, item in self.whole.get(s, ()):
                        if size <= length:
                            mark.append(size)
                            found.add(item)
                    s = self.above[self.link[s]]
                for size in mark:
                    start = at - size
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, at])
        return [(a, b) for a, b in spans], found

    def _stretches(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Maximal runs of words, all adjacent pairs of which occur in items, that are long enough for a window."""
        if len(words) < self.least or not self.words:
            return
        codes = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        joined = (codes[:-1] >= 0) & (codes[1:] >= 0)
        keys = ((codes[:-1] << 32) | codes[1:])[joined]
        if len(self.pairs) and len(keys):
            joined[joined] = self.pairs[np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)] == keys
        else:
            joined[:] = False
        ends = np.append(np.flatnonzero(~joined), len(words) - 1)
        starts = np.append(0, ends[:-1] + 1)
        worth = (ends - starts + 1 >= self.least) & (codes[ends] >= 0)
        for start, end in zip(starts[worth].tolist(), ends[worth].tolist(), strict=True):
            yield start, end + 1


def _matcher(automaton, first: bool, max_coverage: float | None):
    """Adds the automaton's matches to those of earlier ones; with ``max_coverage``, the cleaned text as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton.value
        for batch in small(batches):
            n_words, spans, items, cleaned = [], [], [], []
            before_s, before_i = (None, None) if first else (batch[c].to_pylist() for c in ("spans", "items"))
            for k, text in enumerate(batch["text"].to_pylist()):
                words = split_words(text)
                s, i = auto.hits(words)
                i = {str(x) for x in i if x is not None}
                if not first:
                    s = merge([*((x["start"], x["end"]) for x in before_s[k]), *s])
                    i |= set(before_i[k])
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in s])
                items.append(sorted(i))
                if max_coverage is not None:
                    cleaned.append(without(text, s, len(words), max_coverage))
            columns = [batch["key"], batch["text"], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
            names = ["key", "text", "n_words", "spans", "items"]
            if max_coverage is not None:
                columns.append(pa.array(cleaned, pa.string()))
                names.append("cleaned")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def without(text: str, spans: list[tuple[int, int]], n_words: int, max_coverage: float) -> str | None:
    """The text without the spans of words; None if they hold more than ``max_coverage`` of its words."""
    if sum(b - a for a, b in spans) > max_coverage * n_words:
        return None
    if not spans:
        return text
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data.translate(_TABLE))]
    parts, last = [], 0
    for a, b in spans:
        parts.append(data[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*parts, data[last:]]).decode()


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, joined; in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[list[tuple]]:
    """The items' words in blocks of about ``block_words``, fetched from the cluster one partition at a time."""
    block, n = [], 0
    for row in items.select(F.col(item_id), text_or_empty(item_text)).toLocalIterator():
        words = split_words(row[1])
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        block.append((row[0], words))
        n += len(words)
    yield block


def match(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_coverage: float | None = None) -> DataFrame:
    """One row per document: the id, text, n_words, spans (array of start, end: hit words, joined), items (array of item ids as strings, sorted).

    With ``max_coverage`` also cleaned: the text without its hit spans, null where these hold a larger share of
    the words. Null texts have no words; items without words have no windows. Words in windows of an item with a
    null id are hit, but such an item is not named; items with equal ids count once. Null and repeated document
    ids and rows stay; other columns are left out. Empty tables give no rows, or rows without hits.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"key {kind}, text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    out = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    blocks = item_blocks(items, item_id, item_text, block_words)
    block, k = next(blocks), 0
    while block is not None:
        after = next(blocks, None)
        automaton = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))  # bounded by block_words
        if k:
            out = materialise(out)
        last = max_coverage is not None and after is None
        out = through(out, _matcher(automaton, k == 0, max_coverage if last else None), schema + ", cleaned string" * last)
        block, k = after, k + 1
    return out.withColumnRenamed("key", id_col)


def report(matched: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return matched.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5, text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with hit spans cut out of the texts; documents of which more than ``max_coverage`` of the words are hit go.

    Texts without hits, null ones included, stay as they are; ``chars_col``, where ``docs`` has it, follows the
    text. Other columns and all names stay.
    """
    rest = [c for c in docs.columns if c != text_col]
    row = F.struct(F.col(text_col).isNull().alias("no_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    matched = match(docs.select(row.alias("row"), F.col(text_col).alias("text")), items, id_col="row", max_coverage=max_coverage, **options).filter("cleaned is not null")
    values = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)}
    values[text_col] = F.when(F.col("row.no_text"), F.lit(None)).otherwise(F.col("cleaned"))
    if chars_col in values:
        values[chars_col] = F.when(F.size("spans") > 0, F.length("cleaned").cast("long")).otherwise(values[chars_col])
    return matched.select(*[values[c].alias(c) for c in docs.columns])


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return report(match(docs, items))


OP4_SQL = r"""
with docs as materialized (
  select doc_id, rid, len(words) as n_words, words from (
    select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents)
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark
), windows as (
  select distinct item_id, least(10, len(words)) as n, array_to_string(words[s : s + least(10, len(words)) - 1], ' ') as win
  from items, unnest(range(1, greatest(1, len(words) - 9) + 1)) as t(s) where len(words) > 0
), sizes as (select distinct n from windows), wins as (select distinct win from windows
), grams as (
  select d.rid, p, n, array_to_string(words[p : p + n - 1], ' ') as win
  from docs d, sizes, unnest(range(1, d.n_words - n + 2)) as t(p) where d.n_words >= n
), occ as (select g.rid, g.p, g.n, g.win from grams g join wins using (win)
), hit as (
  select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + n)) as q from occ) group by rid
), named as (
  select rid, count(distinct cast(item_id as varchar)) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from occ join windows using (win) group by rid
)
select d.doc_id, cast(d.n_words as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit, cast(coalesce(m.n_items, 0) as bigint) as n_items, sha256(coalesce(m.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hit h using (rid) left join named m using (rid)
"""
