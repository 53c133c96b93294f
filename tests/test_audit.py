import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from sitegrain import registry
from sitegrain.operators import current, diff, policy
from sitegrain.sources import html

PAGE = "snapshot_id string, url string, final_url string, status int, blocked boolean, error string, x_robots string, redirect_chain array<struct<url:string,status:int,location:string>>, word_count int, content_hash string, " + html.SCHEMA.replace(", visible_text string", "")
SITE = "snapshot_id string, site_url string, has_sitemap boolean, sitemap_url string, sitemap_error string, complete boolean"


def page(url, **fields):
    base = {"snapshot_id": "s", "url": url, "final_url": url, "status": 200, "blocked": False, "redirect_chain": [], "word_count": 300, "h1_count": 1, "og": {"title": "t", "description": "d", "image": "i"}, "twitter": {"card": "c", "title": "t", "description": "d", "image": "i"}}
    base |= {"hreflang": [], "json_ld": [], "images": [], "links": [], "internal_links": [], "external_links": [], "title": f"A title for {url}", "description": f"A description of {url} that is long enough to be of use to all.", "canonical": url, "canonical_raw": url}
    return base | fields


def tables(spark, pages, site=None, listed=()):
    p = spark.createDataFrame(pages, PAGE)
    s = spark.createDataFrame([{"snapshot_id": "s", "site_url": "https://e.com/", "has_sitemap": bool(listed), "sitemap_url": "https://e.com/sitemap.xml", "sitemap_error": None, "complete": True} | (site or {})], SITE)
    return p, s, spark.createDataFrame([("s", u) for u in listed], "snapshot_id string, url string")


def rules_of(spark, pages, **kw):
    p, s, m = tables(spark, pages, kw.pop("site", None), kw.pop("listed", ()))
    return sorted(r.rule for r in current.audit(p, s, m, policy.Policy(**kw)).collect())


def test_basic(spark):
    bare = page("https://e.com/", title=None, description=None, canonical=None, canonical_raw=None, h1_count=0, robots="noindex,follow")
    assert rules_of(spark, [bare]) == ["missing-canonical", "missing-description", "missing-h1", "missing-title", "noindex"]
    assert rules_of(spark, [page("https://e.com/")]) == []
    assert rules_of(spark, []) == []


def test_blocked_and_failed_stop(spark):
    pages = [page("https://e.com/a", blocked=True, title=None), page("https://e.com/b", error="redirect loop x", title=None), page("https://e.com/c", error="timeout", status=None)]
    assert rules_of(spark, pages) == ["page-unreachable", "redirect-loop", "robots-blocked"]


def test_joins(spark):
    pages = [
        page("https://e.com/", internal_links=["https://e.com/bad"], title="Shared title here"),
        page("https://e.com/dup", title=" shared TITLE here", canonical="https://e.com/bad", lang="not_a_language"),
        page("https://e.com/bad", status=404, images=[{"src": "x", "alt": None}], json_ld=[{"valid": False, "value": None, "error": "e"}], hreflang=[{"lang": "en_bad", "url": None}]),
    ]
    got = rules_of(spark, pages, listed=["https://e.com/", "https://e.com/dup"])
    assert got == ["broken-internal-link", "canonical-target-error", "canonical-target-error", "duplicate-title", "duplicate-title", "http-error", "image-missing-alt", "invalid-hreflang", "invalid-language", "malformed-json-ld", "orphan-sitemap-page"]


def test_policy(spark):
    bare = [page("https://e.com/legal/x", title=None)]
    rule = {"rule": "missing-title", "url_pattern": "/legal/**", "expires_at": date(2027, 1, 1)}
    assert rules_of(spark, bare, suppressions=[rule], today=date(2026, 12, 31)) == []
    assert rules_of(spark, bare, suppressions=[rule], today=date(2027, 1, 2)) == ["missing-title"]
    assert rules_of(spark, bare, suppressions=[rule | {"expires_at": date(2020, 1, 1)}]) == ["missing-title"]
    assert rules_of(spark, bare, suppressions=[rule | {"expires_at": date(2999, 1, 1)}]) == []
    assert rules_of(spark, bare, enabled=[]) == []
    p, s, m = tables(spark, bare)
    assert [r.severity for r in current.audit(p, s, m, policy.Policy(overrides={"missing-title": "info"})).collect()] == ["info"]


def test_diff_of_equal_snapshots(spark):
    p, s, m = tables(spark, [page("https://e.com/", title=None)])
    a = current.audit(p, s, m)
    none = a.filter("false").withColumn("before", F.lit(None).cast("string"))
    assert [r.lifecycle for r in diff.diff(a, a, p, s, none).collect()] == ["unchanged"]


def test_diff_tells_evidence(spark):
    """Ongoing issues have their whole evidence, with the URLs of groups; others have what is there now."""
    pages = [page(f"https://e.com/{x}", title='A "shared" title', content_hash="h") for x in "abc"] + [page("https://e.com/d", title=None)]
    states = [tables(spark, [*pages[:2], page("https://e.com/c"), page("https://e.com/d")]), tables(spark, pages)]
    none = current.audit(*states[0]).filter("false").withColumn("before", F.lit(None).cast("string"))
    some = policy.Policy(enabled=["duplicate-title", "duplicate-content", "missing-title"])
    short = diff.diff(*[current.audit(*t, some, with_urls=False) for t in states], states[1][0], states[1][1], none)
    short = spark.createDataFrame(short.collect(), short.schema)
    short = current.with_group_urls(short.filter("lifecycle = 'ongoing'"), {"before": states[0][0], "after": states[1][0]}).unionByName(short.filter("lifecycle <> 'ongoing'"))
    got = {(r.rule, r.url[-1]): (r.lifecycle, r.before, r.after) for r in short.collect()}
    urls = lambda names: "[" + ",".join(f'"https://e.com/{x}"' for x in names) + "]"
    head = r'{"actual":"A \"shared\" title","urls":'
    title = {("duplicate-title", x): ("ongoing", f"{head}{urls('ab')}}}", f"{head}{urls('abc')}}}") for x in "ab"} | {("duplicate-title", "c"): ("new", None, 'A "shared" title')}
    content = {("duplicate-content", x): ("ongoing", f'{{"urls":{urls("ab")}}}', f'{{"urls":{urls("abc")}}}') for x in "ab"} | {("duplicate-content", "c"): ("new", None, None)}
    assert got == title | content | {("missing-title", "d"): ("new", None, None)}


def test_evidence_of_blocked_targets(spark):
    """A blocked page has neither status nor error."""
    pages = [page("https://e.com/", internal_links=["https://e.com/b"], canonical="https://e.com/b", hreflang=[{"lang": "en", "url": None}]), page("https://e.com/b", blocked=True, status=None)]
    got = {r.rule: (r.identity, r.evidence) for r in current.audit(*tables(spark, pages)).collect()}
    target = ('"https://e.com/b"', '{"target":"https://e.com/b","actual":null}')
    assert got == {"robots-blocked": ("null", '{"actual":true}'), "broken-internal-link": target, "canonical-target-error": target, "invalid-hreflang": ('{lang:"en",url:null}', '{"actual":{"lang":"en","url":null}}')}


SQL = ["c1_audit", "c3_diff_lifecycle", "h_extract", "f10_robots_allowed", "s15_checkpoint_last", "st_replay"]


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if name not in registry.oracle_sql() or not os.path.isdir(sf):
        pytest.skip("no SQL or no tables")
    df = registry.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("pages", "documents", "events"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    cols = sorted(df.columns)
    assert sorted(cols) == sorted(names)
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in got.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want
