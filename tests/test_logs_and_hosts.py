import pytest
from pyspark.sql import functions as F

from sitegrain.functions.urls import normalize, normalize_table
from sitegrain.operators import diff
from sitegrain.plans import site_scan
from sitegrain.sources import checkpoint

URLS = ["https://bücher.example/a/", "HTTPS://BÜCHER.example:443/ü?q=ü", "http://[::1]/x", "https://e.com:0443/p", "https://e.com:0080/p", "http://e.com:80", "https://e.com:8443/a/../b", "https://u:p@e.com/x#f", "ftp://e.com/", None, "", "https://", "https://a b/", "https://e.com:99999/", " https://straße.example/x?y=1 ", "https://e.com/p?q=it's \"so\" <b>|x"]


def test_normalize_table(spark):
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(URLS)], "id int, url string, _host string")
    for include in (False, True):
        got = {r.id: r.normalized for r in normalize_table(df, include_query=include).collect()}
        assert got == {i: normalize(u, include_query=include) for i, u in enumerate(URLS)}
    assert normalize_table(df).columns == ["id", "url", "_host", "normalized"] and normalize_table(df.limit(0)).count() == 0


def test_logs_of_one_scan(spark, tmp_path):
    page = lambda u, s: checkpoint.write_lines({"start": "x"}, [{"url": u, "status": 200, "seq": s}])
    (tmp_path / "a").write_text(page("u", 1))
    (tmp_path / "b").write_text(page("v", 2).replace('"x"', '"y"') + "{broken\n" + '{"type": "page", "page": {"url": "w", "seq": 3}}\n')
    (tmp_path / "c").write_text("{torn\n" + page("z", 4))
    urls = lambda **kw: sorted(r.url for r in checkpoint.read_log(spark, str(tmp_path), **kw).collect())
    assert urls(identity={"start": "x"}) == ["u"]
    assert urls(identity={"start": "none"}) == [] == urls(identity={})
    with pytest.raises(ValueError, match="broken"):
        urls(identity={"start": "y"})
    with pytest.raises(ValueError, match="broken"):
        urls()
    assert urls(legacy=True) == ["u", "v", "w", "z"]
    old = '{"type": "page-log", "schemaVersion": 1, "source": {"start": "x", "n": 1}}\n{bad\n{"type": "page", "page": {"url": "o", "seq": 1}}\n{"type": "page", "page": {"status": 1}}\n{"type"'
    (tmp_path / "d").write_text(old)
    assert urls(identity={"n": "1", "start": "x"}, legacy=True) == ["o"] and urls(identity={"start": "x"}, legacy=True) == []


def test_legacy_log_path():
    assert [checkpoint.legacy_log_path(p) for p in ("r.json", "a.b/r", "a/r.x.json", "/.hidden")] == ["r.checkpoint.ndjson", "a.b/r.checkpoint.ndjson", "a/r.x.checkpoint.ndjson", "/.hidden.checkpoint.ndjson"]


def test_cached_pages(spark):
    kind = "snapshot_id string, url string, depth int, title string"
    first = spark.createDataFrame([("s", "u", 3, "old"), ("s", "v", 1, "one")], kind)
    second = spark.createDataFrame([("s", "u", 5, "new")], kind)
    assert {(r.url, r.depth, r.title) for r in site_scan.cached_pages(first, second).collect()} == {("u", 5, "new"), ("v", 1, "one")}


def test_cached_depth_stays(spark):
    table = spark.createDataFrame([("s", "https://e.com/", '<a href="/a">a</a>'), ("s", "https://e.com/a", "")], "snapshot_id string, url string, html string")
    sites = spark.createDataFrame([("s", "https://e.com/")], "snapshot_id string, start_url string")
    texts = lambda urls: urls.select("snapshot_id", "url", F.lit(404).cast("long").alias("status"), F.lit("").alias("body"), F.lit(None).cast("string").alias("error"))
    found = site_scan.scan_sites(sites, site_scan.table_transport(table), texts, {"maxPages": 9})
    cached = found.pages.withColumn("depth", F.col("depth") + 7)
    again = site_scan.scan_sites(sites, site_scan.table_transport(table), texts, {"maxPages": 9}, cached=cached)
    assert {(r.url, r.depth) for r in again.pages.collect()} == {("https://e.com/", 7), ("https://e.com/a", 8)}


def test_gate(spark):
    rows = [("a", "new", "warning", "r1"), ("a", "new", "warning", "r2"), ("b", "resolved", "error", "r1"), ("c", "ongoing", "error", "r1"), ("d", "unchanged", "error", "r1"), ("e", "new", "info", "r9"), ("f", "new", "error", "r1")]
    df = spark.createDataFrame(rows, "snapshot_id string, lifecycle string, severity string, rule string")
    got = {r.snapshot_id: (r.blocked, r.over, r.failed) for r in diff.gate(df, "error", {"warning": 1, "r9": 0, "r1": 5}).collect()}
    assert got == {"a": (False, 1, True), "b": (False, 0, False), "c": (False, 0, False), "d": (False, 0, False), "e": (False, 1, True), "f": (True, 0, True)}
