"""Operators 11 to 13 and the shared join against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import heapq
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitegrain.llm import conversation_repair, source_divergence, token_index
from sitegrain.llm.common import lookup, sieved

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def plain_joins(spark):
    """Shuffled joins whose partitions stay as they are dealt."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["string", "long", "binary"])
def test_lookup_spreads_hot_keys(spark, plain_joins, kind):
    """A third of the rows without a key, a third with a key that the table does not have, a third of others."""
    key = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 1_000_001).otherwise(F.col("id")).cast("string").cast("long" if kind == "long" else "string").cast(kind)
    rows = spark.range(0, 120_000, 1, 4).select(F.col("id").alias("_hot"), key.alias("k"), F.lit(1).alias("_lookup"), F.lit(2).alias("_spread"))
    table = rows.filter("k is not null").filter(F.col("_hot") % 3 == 2).select("k", (F.col("_hot") * 2).alias("twice"), F.lit(0).alias("_lookup_is"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = lookup(rows, table, "k", sizes, 120_000).withColumn("part", F.spark_partition_id())
    parts = sorted(r["count"] for r in got.groupBy("part").count().collect())
    assert sum(parts) == 120_000 and parts[-1] <= 2 * parts[len(parts) // 2]
    assert got.filter("twice is not null and twice = 2 * _hot").count() == 40_000 == got.filter("twice is not null").count()
    hot = table.unionAll(spark.createDataFrame([(1_000_001, -1, 0)], "k long, twice long, _lookup_is int").select(F.col("k").cast("string").cast(kind), "twice", "_lookup_is"))
    assert lookup(rows, hot, "k", sizes, 120_000).filter("twice = -1").count() == 40_000


DOCS = [(5, "Hello wörld, hello."), (1, None), (3, ""), (None, "no key"), (5, "Hello wörld, hello."), (5, "another five"), (-2, "minus " * 3000), (9, "x"), (2**40, "far")]


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "a", 1, 2) for i, t in DOCS], "doc_id long, text string, key string, shard int, start int").repartition(4)


@pytest.mark.parametrize("as_text", [False, True])
def test_token_index(spark, docs, tmp_path, as_text):
    folder = f"file://{tmp_path}/store"
    kind = "string" if as_text else "long"
    docs = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    token_index.write_store(docs, folder, PATH)
    order = sorted(DOCS, key=lambda r: (r[0] is not None, str(r[0]) if as_text else r[0] or 0))
    key = lambda i: None if i is None else str(i) if as_text else i
    total = sum(len(ids_of(t)) for _, t in DOCS)
    rows = token_index.fetch(spark, folder, docs).collect()
    assert Counter((r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in rows) == Counter((key(i), len(ids_of(t)), zlib.crc32(np.array(ids_of(t), "<u4").tobytes())) for i, t in DOCS)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [key(i) for i, _ in order]
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist() and rows[-1].start + rows[-1].n_tokens == total
    store = token_index.TokenStore(folder)
    assert store.width == 2
    for i in {i for i, _ in DOCS}:
        assert Counter(tuple(x.tolist()) for x in store.get(key(i))) == Counter(tuple(ids_of(t)) for j, t in DOCS if j == i)
    other = spark.createDataFrame([(str(k),) for k in (7, 5, 5, 10**12)], "doc_id string").select(F.col("doc_id").cast(kind))
    assert token_index.fetch(spark, folder, other).count() == 3 and store.get(key(7)) == []


def test_token_index_hot_key_and_empty(spark, docs, tmp_path):
    """One key for half of all documents goes on over several shards."""
    many = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string"), F.repeat(F.lit(" more"), 40)).alias("text"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_index.write_store(many, f"{tmp_path}/hot", PATH)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    store = token_index.TokenStore(f"{tmp_path}/hot")
    assert len(store.files) > 4 and len(store.get(7)) == 2001 and len(store.get(9)) == 1
    assert token_index.fetch(spark, f"{tmp_path}/hot", many).count() == 4000
    assert token_index.locate(spark, f"{tmp_path}/hot", many.filter("doc_id = 7")).count() > 3
    token_index.write_store(docs.limit(0), f"{tmp_path}/none", PATH)
    assert token_index.fetch(spark, f"{tmp_path}/none", docs).count() == 0 and token_index.TokenStore(f"{tmp_path}/none").get(1) == []
    assert not [f for f in os.listdir(tmp_path / "none") if f.endswith(".bin")]


def test_files_of_lost_tasks_are_not_read(spark, docs, tmp_path):
    token_index.write_store(docs, f"{tmp_path}/s", PATH)
    (tmp_path / "s" / "ids-00000-lost.bin").write_bytes(b"half")
    (tmp_path / "s" / "index-lost.bin").write_bytes(b"half")
    assert token_index.fetch(spark, f"{tmp_path}/s", docs).count() == len(DOCS)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    digests = np.frombuffer(b"".join(token_index.digest_of(i) for i in range(n)), np.uint8).reshape(-1, 16)
    function = token_index.PerfectHash.build(digests)
    assert sorted(function.slots(digests).tolist()) == list(range(n))
    data = function.to_bytes() + b"rest"
    again, used = token_index.PerfectHash.from_bytes(data)
    assert data[used:] == b"rest" and (again.slots(digests) == function.slots(digests)).all()
    others = np.frombuffer(b"".join(token_index.digest_of(f"x{i}") for i in range(500)), np.uint8).reshape(-1, 16)
    assert (function.slots(others) < max(1, n)).all()
    assert len(function.bits) * 64 <= 8 * n + 700


def cheapest(rows):
    """Dijkstra over (cost, audit) strings, one edit at a time: rows of (role, fault)."""
    queue, seen = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if i == len(rows) and (state == 3 or not out):
            return cost, audit, list(out)
        if (i, state, bool(out)) in seen:
            continue
        seen.add((i, state, bool(out)))
        target = 3 if state == 2 else 2
        name = {2: "user", 3: "assistant"}[target]
        steps = [(3, "I", i, target, (name, ""))]
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append((4, "D", i + 1, state, None))
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                steps.append((3 + late, "R", i + 1, target, (name, text)))
                fits = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
                if fits:
                    steps.append((late, "K", i + 1, fits, (role, text)))
        for c, e, j, t, made in steps:
            heapq.heappush(queue, (cost + c, audit + e, j, t, out + (made,) if made else out))


def judged(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def talks(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.randint(0, 9)):
            turn = rng.choice([None, *range(8)])
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No!", "so", "what? \n", " \t", "", None, "ok.", "é…", "hm"])))
    return rows


def in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return [(t, r, x) for t, r, x in sorted(((t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows), key=key)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_conversation_repair(spark, seed):
    rows = talks(seed)
    table = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn int, role string, text string, phase int, print string").repartition(3)
    extra = spark.createDataFrame([(999,)], "conv_id long")
    want, repaired = {}, []
    for conv in {r[0] for r in rows} | {999}:
        ordered = in_order([r for r in rows if r[0] == conv])
        faults = judged([(r, x) for _, r, x in ordered])
        cost, audit, out = cheapest(faults)
        known = sorted({t for t, _, _ in ordered if t is not None})
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(faults, faults[1:], strict=False)]
        count = Counter(f for _, _, f in faults)
        want[conv] = (known[-1] - known[0] + 1 - len(known) if known else 0, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest())
        repaired += [(conv, i, r, x) for i, (r, x) in enumerate(out)]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.report(table, extra).collect()}
    assert got == want
    assert Counter((r.conv_id, r.position, r.role, r.text) for r in conversation_repair.repair(table).collect()) == Counter(repaired)


def test_conversation_repair_long_and_empty(spark):
    """A conversation of many turns, most of them repeats, and tables without rows."""
    rows = [("a", i, "user" if i % 2 == 0 else "assistant", f"line {i}." if i % 5 else "same.") for i in range(20_000)]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(5)
    got = conversation_repair.report(table).first()
    cost, audit, out = cheapest(judged([r[2:] for r in rows[:400]]))
    assert got.audit[:300] == audit[:300] and len(got.audit.replace("I", "")) == 20_000 and got.duplicate == 3998
    assert conversation_repair.repair(table).count() > 15_000
    none = table.limit(0)
    assert conversation_repair.report(none).count() == 0 == conversation_repair.repair(none).count()
    alone = conversation_repair.report(none, table).first()
    assert tuple(alone) == ("a", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversation_repair.advance.cache_info().currsize < 1000


def test_conversation_sql(spark, tmp_path):
    rows = [(c, t, r, x) for c, t, r, x in talks(4) if t is not None and r is not None]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = conversation_repair.op12_conversation_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(conversation_repair.OP12_SQL)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return LETTERS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def diverge(rows, least, top=50):
    rows = [(a or "", b or "", terms(t)) for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(t for _, _, x in mine for t in set(x))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: Counter(t for _, b, x in mine if b == s for t in x if df[t] >= least) for s in {r[1] for r in mine}}
        chance = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: chance(c) for s, c in counts.items()}, chance(sum(counts.values(), Counter()))
        for s in p:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            marked = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", marked, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, n) for n, (i, v) in enumerate(ranked, 1)]
    return Counter(out)


def writings(seed, sources):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdEé") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = [(rng.choice(["en", "de", None]), rng.choice(sources), rng.choice([" ", "-", "7"]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(300)]
    return [*rows, ("xx", "only", "few words"), ("xx", "other", None), ("yy", None, ""), ("en", "silent", None), *[rows[0]] * 5]


@pytest.mark.parametrize(("sources", "cells", "rounds"), [(["a", "b", None], 1 << 18, 8), (list("abcdefgh"), 7, 2), (list("abcdefg"), 50, 3)])
def test_divergence(spark, sources, cells, rounds):
    rows = writings(len(sources), sources)
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, source string, text string, block int, seat int, term string").repartition(3)
    got = source_divergence.divergence(table, min_docs=10, top=5, block_cells=cells, rounds=rounds)
    assert Counter(map(tuple, got.collect())) == diverge(rows, 10, 5)


def test_divergence_edges(spark, monkeypatch):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert source_divergence.divergence(none).count() == 0
    text = "Aé b-c " * 50 + "verylongterm" * 40 + " end"
    for piece in (16, 64, 1 << 22):
        monkeypatch.setattr(source_divergence, "PIECE", piece)
        assert [t.decode() for part in source_divergence.terms_of(text.encode()) for t in part] == terms(text)


@pytest.mark.parametrize("seats", [1, 2, 3, 4, 7, 8, 21])
def test_round_robin(seats):
    met = Counter()
    for round_ in range(seats + seats % 2 - 1):
        pairs = {(s, source_divergence.opponent(s, seats, round_)) for s in range(seats)}
        assert all((b, a) in pairs for a, b in pairs if b < seats)
        met.update((a, b) for a, b in pairs if b < seats)
    assert met == Counter((a, b) for a in range(seats) for b in range(seats) if a != b)


def test_exact_chances():
    rng = random.Random(5)
    for _ in range(200):
        kept, total = rng.randint(1, 10**6), rng.randint(0, 8 * 10**15)
        counts = np.array([rng.randint(0, total) for _ in range(5)], np.int64)
        assert source_divergence.chances(counts, total, kept).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * kept) for c in counts.tolist()]
    with pytest.raises(ValueError):
        source_divergence.chances(np.zeros(1, np.int64), 9 * 10**15, 1)


def test_pipeline_stages_with_clashing_names(spark, tmp_path):
    """Columns named like the stages' own helpers stay as they are."""
    import corpus_pipeline

    names = ["_n", "_lang_key", "_reference", "_hot", "_spread", "_got", "_cold", "_own_key", "_lookup", "_lookup_is", "fp", "spans", "cut", "hot", "node", "root"]
    rng = random.Random(2)
    words = "the and of a in is to we it that with for on as was by this you from have".split()
    texts = [" ".join(rng.choice([*words, "river", "stone", "market", "garden", "window"]) for _ in range(rng.randint(120, 200))) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t or ""), *range(len(names))) for i, t in enumerate([*texts, texts[0], None, ""])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    now = spark.createDataFrame(rows, schema).repartition(3)
    spark.createDataFrame([(1, "nothing that occurs there at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == [f.split()[0].strip("`") for f in schema.split(", ")]
        got = now.select(*names).distinct().collect()
        assert [tuple(r) for r in got] == [tuple(range(len(names)))]


def test_sieve_holds_back_no_match(spark):
    rows = spark.range(0, 5000, 1, 3).select(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("fp"), (F.col("id") % 10 == 0).alias("in"), F.lit(1).alias("maybe_at"))
    keys = rows.filter("in").select("fp")
    told = sieved(rows, keys, "fp", "maybe")
    assert told.columns == [*rows.columns, "maybe"]
    assert told.filter("in and not maybe").count() == 0 and told.filter("maybe").count() < 1000
    assert sieved(rows, keys.limit(0), "fp", "maybe").filter("maybe").count() == 0
