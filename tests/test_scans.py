import io
import json

import pytest
from pyspark.sql import functions as F

from sitegrain.operators import report
from sitegrain.plans import config, scan
from sitegrain.plans.crawl import RequestGate
from sitegrain.sources import documents


def test_config():
    assert config.resolve({"maxPages": 9}, {"maxPages": 250, "delay": 500}, {"delay": 7, "timeout": 10_000}) | {} == config.resolve({}) | {"maxPages": 9, "delay": 500}
    assert config.resolve({"report": {"logo": "a"}}, {"report": {"logo": "b", "agencyName": "c"}})["report"] == {"logo": "a", "agencyName": "c"}
    for bad in ({"x": 1}, {"maxPages": 0}, {"delay": True}, {"url": "ftp://a"}, {"sitemap": "autos"}, {"severityOverrides": {"a": "bad"}}, {"suppressions": [{"rule": "a"}]}, {"report": {"primaryColor": "red"}}, []):
        with pytest.raises(ValueError):
            config.validate(bad)
    assert config.configuration_hash(config.resolve({"url": "https://example.com/", "maxPages": 1})) == "66ae7d2616f5e03c51981412325fb46717d7727d848fd95763992cb04d85794f"
    assert config.stable_json({"b": [1, None], "a": {"d": True, "C": "é"}}) == '{"a":{"C":"é","d":true},"b":[1,null]}'


SITE = {"/": (302, {"location": "/a"}, b""), "/a": (200, {"content-type": "text/html"}, b"<h1>x</h1>"), "/loop": (301, {"location": "/loop2"}, b""), "/loop2": (301, {"location": "/loop"}, b""), "/big": (200, {}, b"x" * 2000), "/busy": (503, {"retry-after": "1"}, b"")}


def test_fetch():
    asked, slept = [], []

    def opener(url, timeout, agent):
        asked.append(url)
        status, headers, body = SITE[url.removeprefix("http://h")]
        return status, headers, io.BytesIO(body)

    row = lambda path: scan.page_row("s", "http://h" + path, RequestGate(0), config.resolve({"maxResponseBytes": 1024}), opener=opener, sleep=slept.append)
    got = row("/")
    assert (got["status"], got["final_url"], got["html"], len(got["redirect_chain"])) == (200, "http://h/a", "<h1>x</h1>", 1)
    got = row("/loop")
    assert "loop" in got["error"] and len(got["redirect_chain"]) == 2
    got = row("/big")
    assert got["status"] == 200 and "1024" in got["error"] and got["final_url"] == "http://h/big"
    asked.clear()
    assert row("/busy")["status"] == 503 and len(asked) == 3 and slept == [1.0, 1.0]
    assert scan.retry_after("bad") is None and scan.retry_after("99") == 30_000


def test_plan_menu_steps(spark):
    urls = spark.createDataFrame([("https://h/b",), ("https://h/a",), ("https://h/b",)], "url string")
    plan = scan.plan_scan("https://h/z#x", urls, spark)
    assert [r.url for r in plan.candidates.orderBy("rank", "url").collect()] == ["https://h/z", "https://h/a", "https://h/b"] and plan.mode == "sitemap"
    assert [scan.menu_choice(x, 300) for x in ("", "all", "3", "250", "invalid", "0")] == [("fixed", 100), ("all", 300), ("step", 300), ("fixed", 250), None, None]
    assert list(scan.steps(250)) == [100, 200, 250] and list(scan.steps(250, 240)) == [250]
    now = [0.0]
    throttle = scan.ReportThrottle(clock=lambda: now[0])
    assert not throttle.due(99) and throttle.due(100) and not throttle.due(150)
    now[0] = 6
    assert throttle.due(150) and not throttle.due(150)
    base = spark.createDataFrame([("s", "https://h/a"), ("s", "https://h/b")], "snapshot_id string, url string")
    back = scan.rekey(base, lambda rows: rows.withColumn("final_url", F.concat("url", F.lit("x"))), "https://h", "https://preview")
    assert sorted((r.url, r.final_url) for r in back.collect()) == [("https://h/a", "https://h/ax"), ("https://h/b", "https://h/bx")]


def test_report(spark, tmp_path):
    rows = [("s", "r1", "error", "https://h/1", '<script>"', None), ("s", "r2", "info", "https://h/2", None, "OLD"), ("s", None, None, None, None, None)]
    issues = report.with_defaults(spark.createDataFrame(rows, "snapshot_id string, rule string, severity string, url string, message string, before string"))
    assert issues.filter("rule = 'unknown' and owner = 'seo' and lifecycle = 'current' and fingerprint = 'legacy'").count() == 1
    assert [r.rule for r in report.matching(issues, query=" old ").collect()] == ["r2"] and report.matching(issues, severity="info").count() == 2
    assert [r.rule for r in report.top(issues, 1).collect()] == ["r1"] and report.page_of(issues, 2, 2).count() == 1
    assert any(r.value.startswith('"error","current","r1","seo","https://h/1","<script>"""') for r in report.csv_lines(issues).collect())
    assert report.summary(issues).select("errors", "infos", "affected", "blocked").first() == (1, 2, 3, True)
    report.write_html(issues, str(tmp_path / "r.html"), "T & T", partial=True)
    text = (tmp_path / "r.html").read_text()
    assert "<script>" not in text and "T &amp; T" in text and "Partial" in text and text.count("<tr>") == 4
    assert "<" not in report.safe_json({"a": "</script>&"})


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schemaVersion": 1, "startUrl": "https://h/", "pages": [{"url": "https://h/", "canonical": "c", "links": ["b", "a"]}]}))
    snapshots = documents.read_snapshots(spark, str(tmp_path))
    row = documents.pages(snapshots).first()
    assert (row.canonicalRaw, row.links, row.h1Count, row.blockedByRobots, row.redirectChain) == ("c", ["a", "b"], 0, False, []) and documents.sitemap_urls(snapshots).count() == 0
    (tmp_path / "a.json").write_text(json.dumps({"schemaVersion": 3, "startUrl": "https://h/", "pages": []}))
    with pytest.raises(Exception, match="schema version"):
        documents.read_snapshots(spark, str(tmp_path)).collect()
