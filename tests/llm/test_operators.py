"""Each operator against brute force on a small table with nulls, empty texts, copies, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sitegrain.llm import chat, decontaminate, near_dedup, packing, quality, sharding, suffix_dedup, token_counts, toxicity, url_filter
from sitegrain.llm.tokens import WordTokenizer

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, node long, shard string, ids string"


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    write = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = write(90), write(150)
    texts = [write(rng.randint(1, 200)) for _ in range(25)]
    texts += [f"{write(20)} {passage} {write(30)}" for _ in range(4)] + [base, base, base + " tail", "start " + base]
    words = base.split()
    for k in range(8):
        edited = list(words)
        edited[rng.randrange(len(words))] = f"edit{k}"
        texts.append(" ".join(edited))
    texts += [None, "", "", "one", "one", "a b c", "...", "a" * 900, "x y " * 300, "line one two\n" * 20, "Ünï çödé 😀 " * 60]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, texts[3])]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y", "z") for i, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def removed(texts, length):
    seen = Counter(b[i : i + length] for t in texts for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "passage", "limit"), [(400, 240, 50_000), (60, 40, 50_000), (60, 60, 1)])
def test_suffix_dedup(docs, none, length, passage, limit):
    got = suffix_dedup.dedup(docs, length, max_contexts=limit, passage_length=passage, passage_words=4).collect()
    want = Counter((i, *r) for (i, _), r in zip(ROWS, removed([t for _, t in ROWS], length), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == want
    passages = [[(a, b) for a, b in spans if len((t or "").encode()[a:b].split()) > 4] for (_, t), spans in zip(ROWS, covered([t for _, t in ROWS], passage), strict=True)]
    assert Counter((r.doc_id, tuple(map(tuple, r.passages))) for r in got) == Counter((i, tuple(p)) for (i, _), p in zip(ROWS, passages, strict=True))
    if limit == 1:
        assert suffix_dedup.dedup(none, length).count() == 0


def covered(texts, length):
    """Spans that repeated strings of ``length`` cover in each text, joined."""
    seen = Counter(b[i : i + length] for t in texts for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    return [suffix_dedup.merge_spans((i, i + length) for b in [(t or "").encode()] for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1) for t in texts]


@pytest.mark.parametrize("limit", [50_000, 1])
def test_suffix_clean(docs, none, limit):
    length, words = 60, 12
    order = {t: hashlib.sha256(t.encode()).digest()[:16] for _, t in ROWS if t}
    first = {}
    for t in sorted(order, key=order.get):
        b = t.encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], (t, i))
    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        spans = suffix_dedup.merge_spans((k, k + length) for k in range(len(b) - length + 1) if first[b[k : k + length]] != (t, k))
        spans = [(x, y) for x, y in spans if len(b[x:y].split()) > words]
        left = suffix_dedup.cut(b, spans).decode(errors="ignore") if spans else t
        if left or not spans:
            want.append((i, left, "en", "s", len(left or ""), "x", 1, "y", "z"))
    got = suffix_dedup.clean(docs, length, words, max_contexts=limit)
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == Counter(want)
    kept = " ".join(r.text or "" for r in got.collect())
    passage = ROWS[25][1].split()
    assert kept.count(" ".join(passage[25:105])) == 1  # one occurrence stays
    assert suffix_dedup.clean(docs.select("doc_id", "text")).count() > 0 and suffix_dedup.clean(none).count() == 0


def test_suffix_dedup_long_texts(spark):
    rng = random.Random(9)
    write = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = write(500)
    long = write(400_000) + passage + write(300_000) + passage[:450] + "Z" + write(100)
    texts = [long, write(100) + passage, "q" * 700_000, write(50) + "é" * 300]
    rows = suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = {r.doc_id: [(s["start"], s["end"]) for s in r.spans] for r in rows}
    at = 400_000
    assert spans == {0: [(at, at + 500), (at + 300_500, at + 300_950)], 1: [(100, 600)], 2: [(0, 700_000)], 3: [(50, 650)]}


def test_run_index():
    rng = random.Random(3)
    for _ in range(60):
        rows = []
        for family in range(rng.randint(1, 4)):
            contexts = list({(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12)))) for _ in range(rng.randint(1, 8))})
            rows += [(family, a + b, len(a)) for a, b in contexts]
        rank = random.Random(len(rows)).sample(range(len(rows)), len(rows))
        index = suffix_dedup.RunIndex(rows)
        found, later = index.matches(5, suffix_dedup.np.array(rank))
        for i, (family, data, place) in enumerate(rows):
            for start in range(index.width):
                k = start - index.zero + place
                part = data[k : k + 5] if 0 <= k <= len(data) - 5 else None
                same = [j for j, (f, d, p) in enumerate(rows) if part and j != i and f == family and k - place + p >= 0 and d[k - place + p : k - place + p + 5] == part]
                assert found[i, start] == bool(same) and later[i, start] == any(rank[j] < rank[i] for j in same)


def test_run_index_holds_its_contexts():
    """Walking the runs gives every context back, and runs are few where contexts are alike."""
    rng = random.Random(8)
    base = bytes(rng.choice(b"abcdef") for _ in range(300))
    rows = [(0, base[:k] + b"X" + base[k + 1 :], 100) for k in (5, 40, 200, 280)] + [(0, base, 100)] * 60 + [(1, base[50:250], 50)]
    index = suffix_dedup.RunIndex(rows)
    columns = list(index.columns_of_runs())
    texts = [[] for _ in rows]
    before = list(range(len(rows)))
    for _, symbols, lengths, firsts, lasts, _ in columns:
        after = []
        for symbol, n, first, last in zip(*(x.tolist() for x in (symbols, lengths, firsts, lasts)), strict=True):
            run = before[before.index(first) :][:n]
            assert len(run) == n and run[-1] == last
            after += run
            for row in run if symbol else ():
                texts[row].append(symbol - 1)
        assert sorted(after) == sorted(before)
        before = after
    assert [bytes(t[::-1]) for t in texts] == [d for _, d, _ in rows]
    assert sum(len(lengths) for _, _, lengths, *_ in columns) < 0.1 * sum(len(d) for _, d, _ in rows)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(docs, TOKENIZER, max_length=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.length & (r.length - 1) == 0 and r.length <= 64 for r in rows)
    pieces = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.offset == 0
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    for i, t in ROWS:
        if i == 3:
            continue
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert b"".join(b for _, b in sorted(pieces[i])) == b"".join(x.to_bytes(4, "little") for x in ids)
    d = packing.digest(packing.pack(docs, TOKENIZER)).filter("doc_id = 0").first()
    assert d.ids_crc32 == zlib.crc32(sorted(packing_bytes(docs, 0))[0][1])
    assert packing.pack(none, TOKENIZER).count() == 0


def test_packing_where_tokens_hold_blanks(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    assert not WordTokenizer(path).by_words and WordTokenizer(TOKENIZER).by_words
    texts = ["two words  and\nblanks ", "", " x", "Ünï 😀" * 50]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).orderBy("doc_id", "start").collect()
    for i, t in enumerate(texts):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        assert b"".join(bytes(r.ids) for r in rows if r.doc_id == i) == b"".join(x.to_bytes(4, "little") for x in ids)
    with pytest.raises(ValueError):
        token_counts.CountTree("a b", WordTokenizer(path))


def test_tokenizer_on_long_and_odd_texts(monkeypatch):
    from sitegrain.llm import tokens

    plain = WordTokenizer(TOKENIZER)
    rng = random.Random(12)
    bits = ["it's", "DON'T", "a1b2", "é\u0301", "e\u0301", "ﬁ", "\u00a0", "\u3000", "\t", "\r\n", "\x0b", "\x0c", "<|endoftext|>", "x<|endoftext|>y", "...", "!?", "ÀÉ,", "ß", "İ", "日本", "😀😀", "''", "'", "a'b", "_a_", "\u2028", "\x1c", "\x85"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "", "  ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts.append(" ".join(rng.choice(bits) for _ in range(5000)))
    want = [plain.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for piece, cache in ((1 << 21, 300_000), (300, 20)):
        monkeypatch.setattr(tokens, "PIECE", piece)
        monkeypatch.setattr(tokens, "CACHE_WORDS", cache)
        own = WordTokenizer(TOKENIZER)
        got = [ids for a, b in tokens.slices(texts, piece) for ids in own.encode_many(texts[a:b])]
        assert [g.tolist() for g in got] == want
        assert [own.encode(t).tolist() for t in texts] == want


def packing_bytes(docs, doc):
    return [(r.start, bytes(r.ids)) for r in packing.pack(docs.filter(F.col("doc_id") == doc), TOKENIZER).collect()]


def shingles(t):
    w = decontaminate.split_words(t or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


@pytest.mark.parametrize("nodes", [4096, 2])
def test_near_dedup(docs, none, nodes, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_NODES", nodes)
    up = list(range(len(ROWS)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [shingles(t) for _, t in ROWS]
    for i in range(len(ROWS)):
        for j in range(i):
            both, total = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if (ROWS[i][1] or "") == (ROWS[j][1] or "") or (total and both / total >= 0.8):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(ROWS)):
        groups[root(i)].append(i)
    want = Counter((ROWS[i][0], min((ROWS[j][0] for j in g if ROWS[j][0] is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup.classes(docs).collect()) == want
    if nodes == 2:
        assert near_dedup.classes(none).count() == 0 and near_dedup.keep_one(none).count() == 0
        kept = near_dedup.keep_one(docs)
        least = Counter(min((ROWS[j][0] for j in g if ROWS[j][0] is not None), default=None) for g in groups.values())
        assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == least


def test_near_dedup_recall(spark):
    """Every link of sf0.01 (by prefix-filtered brute force over all texts) lies inside one class."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in rows]
    often = Counter(x for s in sets for x in s)
    index, links = defaultdict(list), 0
    of = {r.doc_id: r.class_id for r in near_dedup.op3_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    for i, own in enumerate(sets):
        elements = sorted(((x, k) for x, n in own.items() for k in range(n)), key=lambda e: (often[e[0]], e))
        prefix = elements[: len(elements) - -(-8 * len(elements) // 10) + 1] if elements else []
        for j in {j for e in prefix for j in index[e]}:
            both = sum((own & sets[j]).values())
            if both >= 0.8 * (len(elements) + sum(sets[j].values()) - both):
                links += 1
                assert of[rows[i].doc_id] == of[rows[j].doc_id]
        for e in prefix:
            index[e].append(i)
    assert links > 20 and len(set(of.values())) > 0.5 * len(rows)


def test_dart_similarity():
    import numpy as np

    a, b = np.arange(1, 200, dtype=np.uint64), np.arange(40, 240, dtype=np.uint64)
    owner = np.repeat([0, 1], [len(a), len(b)])
    weights = np.ones(len(owner), np.int64) * 3
    signs = near_dedup.signatures(owner, near_dedup.mix(np.concatenate([a, b])), weights, 2, 2048)
    assert abs((signs[0] == signs[1]).mean() - 160 / 239) < 0.05


def test_decontaminate(spark, docs, none):
    base = next(t for i, t in ROWS if i == 29)
    words = base.split()
    items = [(1, " ".join(words[10:40])), (2, "One"), (10, "a B-c"), (4, None), (None, "x y"), (5, " ".join(words[:9])), (6, " ".join([*words[3:12], "zzz", *words[50:60]])), (7, " ".join(words[10:40]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    coded = [(i, decontaminate.split_words(t or "")) for i, t in items]
    windows = defaultdict(set)
    for i, w in coded:
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[s : s + n])].add(i)

    def brute(t):
        w = decontaminate.split_words(t or "")
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    ids |= {str(x) for x in found if x is not None}
        return hit, (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))

    def without(t, hit):
        """The text without its hit words; the blanks between two hit words go with them."""
        at = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())]
        gone = {x for k in hit for x in range(*at[k])} | {x for k in hit if k + 1 in hit for x in range(at[k][1], at[k + 1][0])}
        return t if not hit else bytes(x for k, x in enumerate(t.encode()) if k not in gone).decode()

    want = Counter((i, *brute(t)[1]) for i, t in ROWS)
    for block in (500_000, 20):
        got = decontaminate.report(decontaminate.match(docs, table, block_words=block)).collect()
        assert Counter(map(tuple, got)) == want
        kept = [(i, without(t, brute(t)[0])) for i, t in ROWS if len(brute(t)[0]) <= 0.5 * brute(t)[1][0]]
        cleaned = decontaminate.clean(docs, table, block_words=block)
        assert cleaned.columns == docs.columns and Counter(map(tuple, cleaned.collect())) == Counter((i, t, "en", "s", len(t or ""), "x", 1, "y", "z") for i, t in kept)
    assert decontaminate.clean(docs.select("doc_id", "text"), table).count() == len(kept)
    assert decontaminate.match(none, table).count() == 0 and decontaminate.match(docs, table.limit(0)).filter("size(items) > 0").count() == 0


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    plain, fast, rng = Tokenizer.from_file(TOKENIZER), WordTokenizer(TOKENIZER), random.Random(5)
    count = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    for _, t in ROWS[::3]:
        text = t or ""
        tree = token_counts.CountTree(text, fast)
        for _ in range(15):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 5, 60]))
            new = rng.choice(["", "x", " new words ", "don't", "\n", "é" * 3, "long " * 1000])
            text = text[:a] + new + text[b:]
            assert tree.edit(a, b, new) == count(text) and tree.text() == text
    with_edits = docs.withColumn("edits", token_counts.standard_edits(F.coalesce("text", F.lit(""))))
    for r in token_counts.count_with_edits(with_edits, TOKENIZER, "edits").filter("doc_id is not null").collect():
        text = ROWS[r.doc_id][1] or ""
        n, after = len(text), []
        for a, b, new in ((n // 3, n // 3, " revised edition 2"), (n // 2, n // 2 + 25, ""), (n - 10, n - 4, "Don't stop")):
            a = min(max(a, 0), len(text))
            text = text[:a] + new + text[min(max(b, a), len(text)) :]
            after.append(count(text))
        assert (r.n_tokens, r.tokens_after, r.n_tokens_edited, r.n_chars_edited) == (count(ROWS[r.doc_id][1] or ""), after, after[-1], len(text))
    assert token_counts.count_with_edits(none.withColumn("edits", F.lit(None).cast(token_counts.EDITS)), TOKENIZER, "edits").count() == 0


def test_quality(docs, none):
    def brute(t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeat = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        n = len(words)
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeat), n < 20 or 100 * len(repeat) > 30 * n

    rows = quality.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == Counter((i, *brute(t)) for i, t in ROWS)
    assert Counter((r.doc_id) for r in rows if r.kept) == Counter(r.doc_id for r in quality.keep(docs).collect())
    assert quality.judge(none).count() == 0 and quality.keep(none).count() == 0


def test_quality_words(spark):
    rng = random.Random(5)
    rare = ["".join(rng.choice("bcdfgklmnprstvaeiou") for _ in range(7)) for _ in range(400)]
    parts = {"en": "the of and to in a is that it for on with".split(), "fr": "le la les de des du et un une que qui dans".split()}
    clean = lambda lang: " ".join(rng.choice(parts[lang]) if rng.random() < 0.27 else rng.choice(rare) for _ in range(200))
    junk = lambda: " ".join(rng.sample(rare, 120))
    rows = [(f"clean {lang} {i}", lang, clean(lang)) for lang in parts for i in range(60)]
    rows += [(f"junk {lang} {i}", lang, junk()) for lang in parts for i in range(5)]
    rows += [(f"wrong {lang} {i}", lang, clean("fr" if lang == "en" else "en")) for lang in parts for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id string, lang string, text string")
    assert sorted(r.doc_id for r in quality.judge(docs).collect() if r.kept) == sorted(i for i, *_ in rows if i.startswith("clean"))
    assert sorted(r.doc_id for r in quality.keep(docs).collect()) == sorted(i for i, *_ in rows if i.startswith("clean"))


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_quality_languages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "BROADCAST_LANGS", broadcast, raising=False)
    rng = random.Random(6)
    letters = {"latin": "bcdfgklmnprstvaeiou", "greek": "αβγδεζηθικλμνοπρστ"}
    clean = lambda kind: " ".join("".join(rng.choice(letters[kind]) for _ in range(rng.randint(3, 8))) for _ in range(120))
    soup = lambda: " ".join("".join(rng.choice("#$%&|<>*") for _ in range(5)) for _ in range(120))
    langs = [(f"l{i}", "latin", 20) for i in range(65)] + [("rare", "latin", 18), ("el", "greek", 5), (None, "latin", 3), (None, "greek", 2)]
    rows = [(f"clean {lang} {kind} {i}", lang, clean(kind)) for lang, kind, n in langs for i in range(n)]
    rows += [(f"soup {lang}", lang, soup()) for lang in sorted({x for x, *_ in langs if x}) + [None, "single"]]
    docs = spark.createDataFrame(rows, "doc_id string, lang string, text string")
    want = sorted(i for i, *_ in rows if i.startswith("clean"))
    assert sorted(r.doc_id for r in quality.judge(docs).collect() if r.kept) == want
    assert sorted(r.doc_id for r in quality.keep(docs).collect()) == want


def test_maximal_segments():
    """Places and scores of all maximal segments: the best one, then those of what lies before and after it."""
    rng = random.Random(11)
    for _ in range(300):
        values = [rng.choice([-2.0, -1.0, 1.0, 2.0]) + rng.random() / 7 for _ in range(rng.randint(0, 14))]

        def best(a, b):
            top = max(((sum(values[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            return [] if not top or top[0] <= 0 else [*best(a, top[1]), (top[1], top[2], top[0]), *best(top[2], b)]

        got, want = toxicity.maximal_segments(values), best(0, len(values))
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want, strict=True))


def test_toxicity_model(spark):
    """Log-odds with a Dirichlet prior, lambda and K against their definitions on a small table."""
    import math

    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6))) for _ in range(120)]
    bad = ["vileword", "vilewords", "nastyone"]
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        if toxic:
            text[1:1] = rng.choices(bad, k=rng.randint(3, 5))
        texts.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    first = [(set(re.findall(r"[^\W\d_]+", t)), y) for (i, t), (_, y) in zip(texts, labels, strict=True) if fold(i) not in (0, 4)]
    n1, n0 = sum(y for _, y in first), sum(1 - y for _, y in first)
    counts = defaultdict(lambda: [0, 0])
    for found, y in first:
        for f in {f for w in found for f in toxicity.features_of(w)}:
            counts[f][y] += 1
    want = {}
    for f, (other, toxic) in counts.items():
        prior = (toxic + other) / (n0 + n1) * toxicity.PRIOR
        if toxic < toxicity.MIN_DOCS or toxic + other >= n0 + n1:
            continue
        odds = lambda y, m: math.log((y + prior) / (m + toxicity.PRIOR - y - prior))  # noqa: B023, E731
        score = odds(toxic, n1) - odds(other, n0)
        if score >= toxicity.MIN_SCORE and score / math.sqrt(1 / (toxic + prior) + 1 / (other + prior)) >= toxicity.MIN_Z:
            want[f] = min(score, toxicity.HIGHEST)
    assert model.scores.keys() == want.keys() and {"vileword", "nastyone"} <= want.keys()
    assert all(abs(model.scores[f] - want[f]) < 1e-9 for f in want)
    held = [(re.findall(r"[^\W\d_]+", t), y) for (i, t), (_, y) in zip(texts, labels, strict=True) if fold(i) == 4]
    seen = Counter(round(model.word_score(w), 1) for found, y in held if not y for w in found)
    total = sum(seen.values())
    shares = {v: c / total for v, c in seen.items()}
    for v in {round(s, 1) for s in model.scores.values()}:
        shares.setdefault(v, 0.5 / total / len(model.scores))
    assert abs(sum(p * math.exp(model.rate * s) for s, p in shares.items()) / sum(shares.values()) - 1) < 1e-6
    best = [(max((s for *_, s in toxicity.maximal_segments([model.word_score(w) for w in found])), default=0.0), len(found)) for found, y in held if not y]
    assert abs(math.log(model.k) - max(-12.0, sum(model.rate * b - math.log(n) for b, n in best) / len(best) - 0.5772)) < 1e-6
    rows = toxicity.score(docs, model).collect()
    for r in rows:
        found = texts[r.doc_id][1].split()
        floor = math.log(max(model.k * len(found), 1e-9))
        segments = [(a, b, model.rate * s - floor) for a, b, s in toxicity.maximal_segments([model.word_score(w) for w in found]) if model.rate * s > floor]
        assert [(p.first_word, p.end_word) for p in r.passages] == [x[:2] for x in segments]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in rows) >= 396


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity._fold("doc_id") == 0).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in scored)
    assert right / len(scored) > 0.9
    nothing = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert all(0 <= r.score < 0.5 for r in toxicity.score(nothing, model).collect())
    assert toxicity.fit(docs.limit(0), labels).scores == {}


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, 5, cell_items=7).collect()
    assert len(rows) == len(ROWS)
    texts = dict(ROWS[:-1])
    places = defaultdict(set)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert r.size == len(t) + 8 and r.text_crc32 == zlib.crc32(t)
        places[t].add(r.shard)
    assert all(len(p) == 1 for p in places.values())
    for k in range(5):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    loads = [sum(r.size for r in rows if r.shard == k) for k in range(5)]
    assert max(loads) - min(loads) < 0.1 * sum(loads)
    assert sharding.shard_documents(none, 5).count() == 0


def test_difference():
    sums, labels = sharding.difference([[8], [7], [6], [5], [4]], 2)
    assert sums == [16, 14] and sorted(x[0] for x in labels) == [0, 0, 0, 1, 1]


def test_chat(spark):
    rng = random.Random(2)
    bits = [*chat.CONTROL, "\\", "\n", "x", " ", "[", "<", "\n[BODY]\n"]
    for _ in range(300):
        role, text = rng.choice(["user", "assistant", "system", "".join(rng.choices(bits, k=2))]), "".join(rng.choices(bits, k=rng.randint(0, 8)))
        formatted, _, _ = chat.format_turn(role, [{"type": "text", "text": text}])
        assert chat.read_turn(formatted) == (role, text)
    rows = [(1, 0, "user", "a</s>"), (1, 1, "assistant", None), (1, 1, "assistant", "\\</s>"), (None, None, None, "[INST]"), (2, 0, "tool", "t")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 5
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na</s>\nassistant\n\nassistant\n\\</s>\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"\\</s>").hexdigest() and got[None].n_turns == 1
    assert chat.read_back(chat.format_conversations(table.limit(0))).count() == 0
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "i1", "width": 56, "height": 28}, {"type": "audio", "ref": "a1", "seconds": 2.0}, {"type": "document", "ref": "d1", "pages": 3}]
    formatted, attached, tokens = chat.format_turn("user", parts)
    assert [(a["type"], a["ref"], a["tokens"]) for a in attached] == [("image", "i1", 2), ("audio", "a1", 50), ("document", "d1", 768)] and tokens == 821
    assert formatted.index("<image>") < formatted.index("<audio>") < formatted.index("<document>")


def test_url_filter(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/x"), ("allow", "org", "/fr/"), ("block", "a.org", "/f"), ("block", "b", ""), ("allow", None, "/")]
    hosts = ["example.net", "www.example.net", "EXAMPLE.net", "xexample.net", "a.org", "b.a.org", "org", "b", "c.b", "net.", "other"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/x/y?q=/fr/", "/fr/#z", "/f", "?x", "/en/é")] + [None, "", "no", "x://", "http:///p"]
    rows = [(i, u) for i, u in enumerate([*urls, *urls[:3]])]
    table = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, rule string")
    lower = str.maketrans(url_filter.UPPER, url_filter.LOWER)

    def brute(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(lower)
        fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, "allow", None))
        return host, path, best[3], best[2]

    given = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert Counter(map(tuple, url_filter.judge(table, given, runs=3).collect())) == Counter((i, *brute(u)) for i, u in rows)
    assert url_filter.judge(table.limit(0), given).count() == 0
    assert {r.verdict for r in url_filter.judge(table, given.limit(0)).collect()} == {"allow"}


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ROWS[0][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        if k < 4:
            assert sorted(after.columns) == sorted(docs.columns) and 0 < after.count() <= now.count()
        now = after
    assert now.count() == corpus_pipeline.run(spark, folder).count()
