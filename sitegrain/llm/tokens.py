"""Token ids of whole texts by a tokenizer file, with a bounded cache of words."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of one piece of text that is split into words at a time.
PIECE = 1 << 21
#: Words and characters that the cache holds at most before it starts anew.
CACHE_WORDS, CACHE_CHARS = 300_000, 6_000_000
#: So many words are counted one by one, not through Arrow.
FEW = 32
#: The normaliser and the split of tokenizers whose words ``PLAIN`` may cut.
CUTTABLE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: A word of Latin letters and then symbols other than the apostrophe: two pre-tokens, alike under NFC.
PLAIN = r"(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<symbols>[!-&(-/:-@\[-`{-~]*)"
#: The character that stands for each byte: its own where it is printable, else the next one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = dict(zip(_PRINTABLE, _PRINTABLE)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """The text in pieces that end at a blank or newline (longer than ``limit`` only where it has none)."""
    start = 0
    while len(text) - start > limit:
        cut = max(text.rfind(" ", start, start + limit), text.rfind("\n", start, start + limit))
        if cut <= start:
            ends = [x for x in (text.find(" ", start + limit), text.find("\n", start + limit)) if x >= 0]
            if not ends:
                break
            cut = min(ends)
        yield text[start:cut]
        start = cut
    yield text[start:]


def splits_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer's file shows that no token holds or depends on a blank, so that words can be encoded apart."""
    steps = lambda x, key: [] if x is None else x[key] if x["type"] == "Sequence" else [x]
    normal, split = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
    if any(len(a["content"].split()) != 1 or a["lstrip"] or a["rstrip"] for a in spec.get("added_tokens") or []):
        return False
    if all(spec.get(k) == v for k, v in CUTTABLE.items()):
        return True
    plain = all(n["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer") for n in normal)
    return plain and bool(split) and split[0]["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")


class WordTokenizer:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Where tokens never reach over blanks (``by_words``), texts are split at blanks and each different word of a
    slice is looked up once; else whole texts go to the tokenizer. If the tokenizer is of the kind that
    ``CUTTABLE`` states, a plain word is looked up as its letters and its symbols, each encoded by the model, so
    that both are shared with other words.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_words = splits_at_blanks(spec)
        self.plain = re.compile(PLAIN)
        self.cuts = spec["model"]["type"] == "BPE" and all(spec.get(k) == v for k, v in CUTTABLE.items()) and not any(self.plain.fullmatch(a["content"]) for a in spec["added_tokens"])
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.lengths, self.starts, self.flat, self.used, self.chars = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0, 0

    def _store(self, words: list[str], found: list[list[int]]) -> None:
        """Keep words that are not in the index, with their ids."""
        at, n = len(self.index), len(words)
        lengths = np.fromiter(map(len, found), np.int64, n)
        total = int(lengths.sum())
        while at + n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.starts[at : at + n], self.lengths[at : at + n] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += total
        self.chars += sum(map(len, words))
        self.index.update(zip(words, range(at, at + n), strict=True))

    def _pre_token(self, text: str) -> list[int]:
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(BYTE_CHARS)
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def _codes(self, words: pa.Array, encode) -> np.ndarray:
        """A number for each of the words, which may repeat; new ones are encoded first."""
        words = words.dictionary_encode()
        names = words.dictionary.to_pylist()
        codes = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(codes < 0)
        if len(new):
            unknown = [names[i] for i in new.tolist()]
            codes[new] = np.arange(len(self.index), len(self.index) + len(unknown))
            self._store(unknown, encode(unknown))
        return codes[words.indices.to_numpy()]

    def _parts(self, words: pa.Array) -> np.ndarray:
        """Two numbers for each of the different words: of its letters and symbols, or of the word and of nothing."""
        out = np.zeros((len(words), 2), np.int64)
        whole = np.ones(len(words), bool)
        if self.cuts:
            cut = pc.extract_regex(words, pattern=f"^{PLAIN}$")
            whole = ~cut.is_valid().to_numpy(zero_copy_only=False)
            cut = cut.drop_null()
            both = pa.concat_arrays([pc.utf8_lower(cut.field("letters")), cut.field("symbols")])
            out[~whole] = self._codes(both, lambda x: [*map(self._pre_token, x)]).reshape(2, -1).T
        if whole.any():
            out[whole, 0] = self._codes(words.filter(pa.array(whole)), lambda x: [e.ids for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)])
        return out

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(parts of the different words, number of each word among them). Parts are valid until the next call."""
        if len(self.index) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._reset()
        words = words.dictionary_encode()
        return self._parts(words.dictionary), words.indices.to_numpy()

    def _count(self, word: str) -> int:
        """Tokens of one word; what is not in the cache is encoded, but not kept."""
        match = self.plain.fullmatch(word) if self.cuts else None
        if match is None:
            code = self.index.get(word)
            return int(self.lengths[code]) if code is not None else len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        codes = [(part, self.index.get(part)) for part in (match[1].lower(), match[2])]
        return sum(int(self.lengths[code]) if code is not None else len(self._pre_token(part)) for part, code in codes)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; words have no blanks."""
        if len(words) <= FEW:
            return np.array([self._count(w) for w in words], np.int64)
        parts, at = self._look_up(pa.array(words, pa.string()))
        return self.lengths[parts].sum(1)[at]

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        parts, at = self._look_up(words)
        codes = parts[at].ravel()
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.starts[codes] - (ends - lengths), lengths) + np.arange(total)
        return self.flat[places], lengths.reshape(-1, 2).sum(1)

    def encode(self, text: str) -> np.ndarray:
        if not self.by_words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        parts = [self._ids(pc.ascii_split_whitespace(pa.array([p], pa.string())).flatten())[0] for p in pieces(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are together short (see ``slices``)."""
        if len(texts) == 1 or not self.by_words:
            return [self.encode(t) for t in texts]
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        ids, lengths = self._ids(split.flatten())
        ends = np.cumsum(np.concatenate([[0], lengths]))[split.offsets.to_numpy()[1:]]
        return np.split(ids, ends[:-1])


@functools.lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this process: its bounded cache of words outlives a task."""
    return WordTokenizer(path)


def slices(texts: list[str], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` characters together."""
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and chars + len(text) > limit:
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)
