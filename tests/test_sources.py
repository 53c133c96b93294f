import gzip

import pytest
from pyspark.sql import functions as F

from sitegrain.plans import site_scan
from sitegrain.plans.crawl import RequestGate, crawl, query as crawl_query, retry_delay
from sitegrain.sources import checkpoint, html, robots, site_tables, sitemap


def test_extract():
    page = """<html lang="en"><head><title> </title><title>A &amp; B</title><meta name="Description" content=" d "><meta property="og:image" content="/i.png">
    <link rel="canonical alternate" hreflang="en" href="/c?x=1"><script type="application/ld+json">{"a": NaN}</script></head>
    <body><h1>x</h1><h1>foo<b>bar</b></h1><img src="a"><a href="/p/#f">p</a><a href="https://other.org/q">q</a><noscript>no</noscript></body></html>"""
    r = html.extract(page, "https://e.com/a")
    assert (r["title"], r["description"], r["lang"], r["h1_count"]) == ("A & B", "d", "en", 2)
    assert r["canonical"] == "https://e.com/c?x=1" and r["hreflang"] == [{"lang": "en", "url": "https://e.com/c?x=1"}]
    assert r["internal_links"] == ["https://e.com/p"] and r["external_links"] == ["https://other.org/q"]
    assert r["json_ld"][0]["valid"] is False and r["images"] == [{"src": "a", "alt": None}]
    assert r["visible_text"].split() == ["A", "&", "B", "x", "foo", "bar", "p", "q"]
    assert html.extract(None, None)["links"] == []


def test_robots_groups():
    # Fixed case: a directive without a value does not part two agents.
    body = "User-agent: a\nDisallow:\nUser-agent: b\nDisallow: /x"
    assert robots.parse_robots(body, "a") == robots.parse_robots(body, "b") == [("disallow", "/x")]


def test_extract_bases():
    page = '<meta name="description" content="one"><meta name="description" property="og:title" content="two"><link rel="alternate" hreflang=" " href="/x"><link rel="alternate" hreflang=" en " href="y"><a href="n?q=1">n</a>'
    r = html.extract(page, "https://e.com/a", "https://e.com/moved/b")
    assert (r["description"], r["og"]["title"], r["hreflang"]) == ("one", "two", [{"lang": "en", "url": "https://e.com/moved/y"}])
    assert r["links"] == r["internal_links"] == ["https://e.com/moved/n"]
    assert html.extract(page, "https://e.com/a", include_query=True)["internal_links"] == ["https://e.com/n?q=1"]


def test_robots(spark):
    body = "﻿User-agent: a\nUser-agent: audit\nDisallow: /private # x\nAllow: /private/ok$\nDisallow:\n\nUser-agent: *\nDisallow: /"
    assert robots.parse_robots(body, "AuditBot") == [("disallow", "/private"), ("allow", "/private/ok$")]
    assert robots.parse_robots(body, "zzz") == [("disallow", "/")]
    df = spark.createDataFrame([("https://e.com/private/x",), ("https://e.com/private/ok",), ("https://e.com/p",)], "url string")
    assert [r.allowed for r in robots.with_robots(df, robots.parse_robots(body, "audit")).collect()] == [False, True, True]


def test_sitemap(spark):
    xml = '<urlset xmlns="http://s.org/0.9"><url><loc> https://e.com/a </loc></url><url><loc>https://x.org/b</loc></url><url><loc>https://e.com/c.pdf</loc></url></urlset>'
    df = spark.createDataFrame([("https://e.com", xml)], "site string, xml string")
    assert [r.url for r in sitemap.sitemap_urls(df).collect()] == ["https://e.com/a"]
    files = {"https://e.com/s.xml": b"<sitemapindex><sitemap><loc>/a.xml</loc></sitemap><sitemap><loc>https://x.org/b.xml</loc></sitemap></sitemapindex>", "https://e.com/a.xml": gzip.compress(b"<urlset><url><loc>/second</loc></url><url><loc>/first</loc></url></urlset>")}
    out = sitemap.load("https://e.com/s.xml", files.__getitem__)
    assert out["urls"] == ["https://e.com/first", "https://e.com/second"] and out["files"] == 2 and not out["error"]


def test_log(spark, tmp_path):
    text = checkpoint.write_lines({"a": 1}, [{"url": "u", "status": 200, "seq": 1}, {"url": "u", "status": 500, "seq": 2}, {"url": "v", "status": 200, "seq": 3}])
    assert [p["status"] for p in checkpoint.read_lines(text + '{"type": "pa')] == [500, 200]
    with pytest.raises(ValueError, match="record 2"):
        checkpoint.read_lines(text.replace('{"page"', "{broken", 1).replace('{"type": "page"', "{broken", 1))
    (tmp_path / "log.ndjson").write_text(text)
    rows = checkpoint.reusable(checkpoint.last_wins(checkpoint.read_log(spark, str(tmp_path)))).collect()
    assert [r.url for r in rows] == ["v"]
    (tmp_path / "log.ndjson").write_text(text + '{"type": "page", "pa')
    assert checkpoint.read_log(spark, str(tmp_path)).count() == 3
    (tmp_path / "log.ndjson").write_text(text.replace('"seq": 1}', '"seq": 1', 1))
    with pytest.raises(ValueError, match="broken"):
        checkpoint.read_log(spark, str(tmp_path))
    log = str(tmp_path / "own")
    checkpoint.append(spark.createDataFrame([("u", 200, None, 1)], checkpoint.PAGE), log)
    checkpoint.append(spark.createDataFrame([("u", 404, None, 2)], checkpoint.PAGE), log)
    assert [(r.url, r.status) for r in checkpoint.last_wins(checkpoint.read_log(spark, log)).collect()] == [("u", 404)]
    checkpoint.clear(spark, log)
    assert not (tmp_path / "own").exists()


def test_crawl(spark):
    pages = spark.createDataFrame([("s", "https://e.com/", ["https://e.com/b", "https://e.com/a", "https://e.com/x.pdf"]), ("s", "https://e.com/a", ["https://e.com/", "https://e.com/c"])], "site string, url string, internal_links array<string>")
    seeds = spark.createDataFrame([("s", "https://e.com/")], "site string, url string")
    assert {(r.url, r.depth) for r in crawl(seeds, pages).collect()} == {("https://e.com/", 0), ("https://e.com/a", 1), ("https://e.com/b", 1), ("https://e.com/c", 2)}
    assert {r.url for r in crawl(seeds, pages, max_pages=2).collect()} == {"https://e.com/", "https://e.com/a"}
    assert crawl(seeds.limit(0), pages).count() == 0


def test_crawl_whole(spark, tmp_path):
    def brute(pages, seeds):
        depth, level = dict.fromkeys(seeds, 0), list(seeds)
        while level:
            level = [u for v in level for u in pages.get(v, [])]
            level = [u for u in dict.fromkeys(level) if u not in depth and not u[1].endswith(".pdf")]
            depth |= {u: 1 + max(depth.values()) for u in level}
        return depth

    # two sites: a chain whose unlisted pages (number % 3 = 0) lie deep below the seeds, and one of over 40 pages
    page = lambda *links: '<html lang="en"><head><meta charset="utf-8"></head><body>' + "".join(f'<a href="{x}">x</a>' for x in links) + "</body></html>"
    rows = [(1, "https://a.com/", page("/c3", "/f.pdf"))] + [(k, f"https://a.com/c{k}", page(f"/c{k + 3}", "/")) for k in range(3, 24, 3)]
    rows += [(100 + k + (k > 28), f"https://b.com/p{k}", page(f"/p{(k * 7) % 60}", "/nowhere")) for k in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    s = site_tables.snapshot(spark, str(tmp_path))
    pages = {(r.snapshot_id, r.url): [(r.snapshot_id, x) for x in r.internal_links] for r in s.pages.collect()}
    first = {}
    for _, url, _ in sorted(rows):
        first.setdefault(url[:13], url)
    want = brute(pages, {*first.items(), *((r.snapshot_id, r.url) for r in s.sitemap_urls.collect())})
    got = crawl_query(spark, str(tmp_path)).collect()
    assert {(r.site, r.url): r.depth for r in got} == want and len(got) == len(want)
    assert max(want.values()) > 3 and sum(site == "https://b.com" for site, _ in want) > 40


def test_crawl_each_43rd_page(spark, tmp_path):
    page = '<html><head><meta charset="utf-8"></head><body><a href="/deep">x</a></body></html>'
    spark.createDataFrame([(43, "https://a.com/", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {(r.url, r.depth) for r in crawl_query(spark, str(tmp_path)).collect()} == {("https://a.com/", 0), ("https://a.com/deep", 1)}


def test_scan_sites(spark):
    page = lambda *links: '<html lang="en"><head><title>t</title></head><body>' + "".join(f'<a href="{x}">x</a>' for x in links) + "</body></html>"
    site = {"/": ["/b", "/a", "/x.pdf", "/private/p"], "/a": ["/c", "/missing"], "/b": [], "/c": ["/"], "/private/p": ["/hidden"], "/listed": []}
    table = spark.createDataFrame([("s", f"https://e.com{p}", page(*x)) for p, x in site.items()], "snapshot_id string, url string, html string")
    sites = spark.createDataFrame([("s", "https://e.com/"), ("t", "https://t.com/")], "snapshot_id string, start_url string")
    bodies = {"s": (200, "User-agent: *\nDisallow: /private/"), "t": (403, "")}
    asked = []

    def texts(urls):
        return spark.createDataFrame([(r.snapshot_id, r.url, *bodies[r.snapshot_id], None) for r in urls.collect()], "snapshot_id string, url string, status long, body string, error string")

    def fetched(urls):
        asked.extend(r.url for r in urls.collect())
        return site_scan.table_transport(table)(urls)

    listed = spark.createDataFrame([("s", "https://e.com/listed")], "snapshot_id string, url string")
    levels = []
    found = site_scan.scan_sites(sites, fetched, texts, {"maxPages": 50}, listed, on_level=lambda n, pages: levels.append((n, pages.count())))
    got = {(r.url, r.depth): (r.status, r.blocked) for r in found.pages.collect()}
    e = "https://e.com"
    assert got == {(f"{e}/", 0): (200, False), (f"{e}/listed", 0): (200, False), (f"{e}/a", 1): (200, False), (f"{e}/b", 1): (200, False), (f"{e}/private/p", 1): (None, True), (f"{e}/c", 2): (200, False), (f"{e}/missing", 2): (404, False), ("https://t.com/", 0): (None, True)}
    assert levels == [(0, 3), (1, 3), (2, 2)] and len(set(asked)) == 6
    assert {r.snapshot_id: (r.completed, r.truncated, r.deny_all) for r in found.sites.collect()} == {"s": (7, False, False), "t": (1, False, True)}
    # The same scan with what is there already fetches nothing anew.
    asked.clear()
    again = site_scan.scan_sites(sites, fetched, texts, {"maxPages": 50}, listed, cached=found.pages)
    assert not asked and again.pages.count() == 8
    small = site_scan.scan_sites(sites, fetched, texts, {"maxPages": 2}, listed)
    assert {r.url for r in small.pages.filter("snapshot_id = 's'").collect()} == {f"{e}/", f"{e}/listed"} and small.sites.filter("truncated").count() == 1
    ended = iter([False, True])
    part = site_scan.scan_sites(sites, fetched, texts, {"maxPages": 50}, stop=lambda: next(ended))
    assert part.pages.count() == 2 and {r.partial for r in part.sites.collect()} == {True}
    assert site_scan.scan_sites(sites.limit(0), fetched, texts, {"maxPages": 5}).pages.count() == 0


def test_discover():
    files = {"https://e.com/sitemap_index.xml": b"<sitemapindex/>", "https://e.com/sitemap.xml": b"<html/>"}
    assert sitemap.discover("https://e.com/x", "Sitemap: https://x.org/s.xml\nsitemap: /own.xml?a=1", files.__getitem__) == "https://e.com/own.xml?a=1"
    assert sitemap.discover("https://e.com/x", None, files.__getitem__) == "https://e.com/sitemap_index.xml"
    assert sitemap.discover("https://none.org/", "", files.__getitem__) is None


def test_gate():
    now, slept = [0.0], []
    gate = RequestGate(0.1, lambda: now[0], slept.append)
    for _ in range(4):
        gate.wait()
    assert [round(x, 3) for x in slept] == [0.1, 0.2, 0.3]
    assert retry_delay(2) == 1000 and retry_delay(9) == 30_000 and retry_delay(0, 3) == 3000


def test_records_of_few_pages_are_held_at_once(spark):
    """A worker's memory does not grow with a batch: records leave it in pieces, bounded by rows and by bytes of HTML, and batches are bounded too."""
    import pyarrow as pa

    texts = ["<title>a</title>"] * 1000 + [None] * 3 + ["x" * html.SLICE_BYTES] * 3 + ["y" * (html.SLICE_BYTES // 2)] * 5
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "url": [f"https://e.com/{i}" for i in range(len(texts))], "html": pa.array(texts, pa.string())})
    out = list(html._run(False)(iter([batch, batch.slice(0, 0)])))
    assert [n for b in out for n in b["n"].to_pylist()] == list(range(len(texts)))
    for b in out:
        held = texts[b["n"][0].as_py() : b["n"][-1].as_py() + 1] if b.num_rows else []
        assert len(held) <= 1 or len(held) <= html.SLICE_ROWS and sum(len(x or "") for x in held) <= html.SLICE_BYTES
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 10_000)
    rows = html.extract_pages(spark.createDataFrame([("https://e.com/", "<title>a</title>")], "url string, html string"))
    assert int(spark.conf.get(key)) <= html.BATCH[key] and rows.first().title == "a"


@pytest.mark.parametrize("most", [None, 3])
def test_crawl_sends_no_level_through_the_driver(spark, most):
    """Small levels and tables would be broadcast, and all levels together are the whole site."""
    store = spark._jsparkSession.sharedState().statusStore()
    pages = spark.createDataFrame([("s", f"https://e.com/{i}", [f"https://e.com/{i + 1}"]) for i in range(4)], "site string, url string, internal_links array<string>").repartition(2)
    known = store.executionsCount()
    got = crawl(pages.limit(1).select("site", F.lit("https://e.com/0").alias("url")), pages, most)
    assert sorted((r.url[-1], r.depth) for r in got.collect()) == [(str(i), i) for i in range(most or 5)]
    plans = [x.physicalPlanDescription() for x in (store.executionsList().apply(i) for i in range(known, store.executionsCount()))]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_a_worker_gets_bounded_batches(spark):
    """What Spark hands a worker at once, after any query on snapshots has been built: at most 2,000 pages and, but for one page, 8 MB."""
    pages = spark.range(0, 5000, 1, 1).selectExpr("concat('https://e.com/', id) as url", "if(id < 3500, '<p>a</p>', repeat('x', 20000)) as html")
    for key, high in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "256m")):
        spark.conf.set(key, high)
    extracted = html.extract_pages(pages)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    seen = pages.mapInArrow(sizes, "n long, size long").collect()
    assert sum(x.n for x in seen) == 5000 and max(x.n for x in seen) <= 2000
    assert max(x.size for x in seen) <= (8 << 20) + 25_000
    assert extracted.filter("length(visible_text) = 20000").count() == 1500
