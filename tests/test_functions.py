import pytest
from pyspark.sql import functions as F

from sitegrain.functions import text, urls


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("url", "want", "query"),
    [
        ("https://example.com/docs/?utm_source=test#intro", "https://example.com/docs", False),
        ("https://example.com/search?q=seo#top", "https://example.com/search?q=seo", True),
        ("HTTPS://Example.COM:443", "https://example.com/", False),
        ("https://example.com/a//", "https://example.com/a", False),
        ("https://example.com/für", "https://example.com/f%C3%BCr", False),
        ("mailto:a@example.com", None, False),
        ("  https://example.com/a/./b/../c/%2e%2E/d \n", "https://example.com/a/d", False),
        ("https://user:pw@example.com\\x y", "https://example.com/x%20y", False),
        ("https://example.com/../..", "https://example.com/", False),
        ("http://[bad", None, False),
        (None, None, False),
    ],
)
def test_normalize(spark, url, want, query):
    assert one(spark, url, lambda x: urls.normalize_url(x, query)) == want
    assert urls.normalize(url, None, query) == want


def test_relative():
    assert urls.normalize("/docs/?utm_source=test#intro", "https://example.com/base") == "https://example.com/docs"
    assert urls.normalize("../c", "https://example.com/a/b") == "https://example.com/c"


@pytest.mark.parametrize(("url", "want"), [("https://e.com/a.pdf", False), ("https://e.com/a.PNG?x", False), ("https://e.com/a.html", True), ("x", False)])
def test_crawlable(spark, url, want):
    assert one(spark, url, urls.is_crawlable) is want


def test_map_origin(spark):
    move = lambda x: urls.map_origin(x, F.lit("https://a.com"), F.lit("https://p.dev"))
    assert one(spark, "https://a.com/x?q", move) == "https://p.dev/x?q"
    assert one(spark, "https://b.com/x", move) == "https://b.com/x"
    assert one(spark, None, move) is None


@pytest.mark.parametrize(("tag", "want"), [("en", True), ("en-US", True), ("x-default", True), ("not_a_language", False), ("abcd", False), ("zh-Hant-TW", True), ("de-1996", True)])
def test_language(spark, tag, want):
    assert one(spark, tag, text.valid_language) is want


@pytest.mark.parametrize(("value", "want"), [("noindex,follow", True), ("follow, NOINDEX", True), ("noindexed", False), (None, False)])
def test_directive(spark, value, want):
    assert one(spark, value, lambda x: text.has_directive(x, "noindex")) is want


def test_text(spark):
    assert one(spark, "  a \n b ", text.clean_text) == "a b"
    assert one(spark, " ", text.clean_text) is None
    assert one(spark, "a\U0001f600", text.utf16_length) == 3
    assert one(spark, 'say "x"\\', text.json_string) == '"say \\"x\\"\\\\"'


@pytest.mark.parametrize(
    ("rule", "want"),
    [("missing-title", "1ed49435730a4ff913a8e15e"), ("missing-canonical", "bd136dda2e1e8a79b286ca2b"), ("missing-description", "48f5482c30c59eb43898afed"), ("missing-h1", "a40898ca6dcfd6a7e05b24cf"), ("low-word-count", "e596a00555b35157fcf9a0c7"), ("missing-open-graph", "0b3e1aa183fd76b0d4c014df"), ("missing-twitter-metadata", "728c10486fac348c43a77c9a")],
)
def test_fingerprints(spark, rule, want):
    found = {one(spark, u, lambda x: text.fingerprint(F.lit(rule), F.lit("page"), x, F.lit("null"))) for u in ("https://example.com/", "https://example.com")}
    assert want in found


def test_glob():
    import re

    assert re.search(text.glob_regex("/legal/**"), "/legal/a/b") and not re.search(text.glob_regex("/legal/*"), "/legal/a/b")


def test_texts_are_cleaned_once(spark, tmp_path):
    """Cleaning is most of the work on texts: one regular expression in the plan, and the same texts as the Python form gives."""
    import random

    from sitegrain import registry
    from sitegrain.functions import text
    from sitegrain.sources import html

    rng = random.Random(3)
    texts = ["".join(rng.choice(" \t\n\x0b\r\u00a0\u2003\ufeffaAé") for _ in range(rng.randrange(9))) for _ in range(2000)] + ["", " ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cleaned = text.clean_text(F.col("text"))
    got = {r.doc_id: (r.c, r.h) for r in rows.select("doc_id", cleaned.alias("c"), text.content_hash(cleaned).alias("h")).collect()}
    assert [got[i][0] for i in range(len(texts))] == [html.clean(x) for x in texts]
    assert all((h is None) == (c is None) for c, h in got.values())
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    groups = registry.queries()["a1_duplicate_content"](spark, str(tmp_path))
    assert groups._jdf.queryExecution().executedPlan().toString().count("regexp_replace(") == 1
    want = {}
    for i, x in enumerate(texts):
        if html.clean(x):
            want.setdefault(html.clean(x).lower(), []).append(i)
    assert sorted((r.n, r.first_doc) for r in groups.collect()) == sorted((len(v), v[0]) for v in want.values() if len(v) > 1)
