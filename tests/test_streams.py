"""Streams and tables that grow with the site: replay, restart, and the same answers as the row-wise forms."""

import random
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from sitegrain.functions import patterns
from sitegrain.operators import order, policy
from sitegrain.sources import checkpoint, html, robots
from sitegrain.streaming import groups, lifecycle, page_table
from sitegrain.streaming.replay import run_available


def test_page_table_restart_and_replay(spark, tmp_path):
    log, path, state = f"{tmp_path}/log", f"{tmp_path}/table", f"{tmp_path}/state"
    rows = [[("a", 200, None, 1), ("b", 404, None, 2), ("a", 500, "x", 3)], [("b", 200, None, 9), ("c", 200, None, 4)], [("b", 503, None, 5), ("a", 301, None, 10)]]
    want = {}
    for wave in rows:
        checkpoint.append(spark.createDataFrame(wave, page_table.PAGE).coalesce(1), log)
        progress = page_table.follow(spark, log, path, state, files=1)
        assert sum(p["rows"] for p in progress) == len(wave)
        for r in wave:
            if r[3] >= want.get(r[0], (0,) * 4)[3]:
                want[r[0]] = r
        table = page_table.KeyedTable(spark, f"{path}/pages", page_table.PAGE, ["url"], "seq")
        assert sorted(tuple(r) for r in table.read().collect()) == sorted(want.values())
    again = spark.createDataFrame(rows[1], page_table.PAGE)
    table.upsert(again, 1)  # a batch that is run again changes nothing
    assert sorted(tuple(r) for r in table.read().collect()) == sorted(want.values())
    assert sorted(r.url for r in table.read(before=1).collect()) == ["a", "b"]


def test_page_table_keeps_broken_lines_and_compacts(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "one").write_text('{"type":"page-log","schemaVersion":2}\n{"type":"page","page":{"url":"u","status":200,"seq":1}}\n\n{"type":"page","pa')
    page_table.follow(spark, f"{tmp_path}/log", f"{tmp_path}/t", f"{tmp_path}/s")
    assert [r.broken for r in spark.read.parquet(f"{tmp_path}/t/broken").collect()] == ['{"type":"page","pa']
    table = page_table.KeyedTable(spark, f"{tmp_path}/k", page_table.PAGE, ["url"], "seq", every=2)
    for n in range(7):
        table.upsert(spark.createDataFrame([(f"u{n % 3}", n, None, n)], page_table.PAGE), n)
    assert sorted(tuple(r) for r in table.read().collect()) == [("u0", 6, None, 6), ("u1", 4, None, 4), ("u2", 5, None, 5)]
    assert len(table._numbers("base")) <= 2 and len(table._numbers("delta")) <= 4
    assert page_table.KeyedTable(spark, f"{tmp_path}/none", page_table.PAGE, ["url"], "seq").read().count() == 0


def test_lifecycles_over_three_snapshots(spark, tmp_path):
    """Resolved only where the page was checked; a snapshot that comes again and a restart change nothing."""
    issue = "snapshot_id string, fingerprint string, rule string, severity string, scope string, url string, message string, evidence string"
    make = lambda rows: spark.createDataFrame([("s", fp, "r", "error", scope, url, "m", evidence) for fp, scope, url, evidence in rows], issue)
    snapshots = [
        ([("1", "page", "a", "x"), ("2", "page", "b", "x"), ("3", "site", "map", "x")], ["a", "b"], True),
        ([("1", "page", "a", "y"), ("4", "page", "c", "x")], ["a", "c"], False),
        ([("2", "page", "b", "x"), ("5", "site", "map", "z")], ["a", "b"], True),
    ]
    for seq, (issues, pages, complete) in enumerate(snapshots):
        event = lifecycle.events(seq, make(issues), spark.createDataFrame([("s", u) for u in pages], "snapshot_id string, url string"), spark.createDataFrame([("s", complete)], "snapshot_id string, complete boolean"))
        event.unionAll(event if seq == 1 else event.limit(0)).write.mode("append").parquet(f"{tmp_path}/in")
        run_available(lifecycle.lifecycles(spark.readStream.schema(lifecycle.EVENT).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    got = Counter((r.seq, r.fingerprint, r.lifecycle, r.before, r.after) for r in spark.read.schema(lifecycle.OUT).parquet(f"{tmp_path}/out").collect())
    assert got == Counter([(1, "1", "ongoing", "x", "y"), (1, "4", "new", None, None), (2, "1", "resolved", None, None), (2, "2", "unchanged", None, None), (2, "5", "new", None, None)])


def test_group_rules_follow_every_batch(spark, tmp_path):
    rng, now = random.Random(4), {}
    rules = groups.GroupRules(spark, f"{tmp_path}/g")
    listed = spark.createDataFrame([("s", f"s/{i}") for i in range(8)], "snapshot_id string, url string")
    for batch in range(5):
        rows = [("s", f"s/{rng.randrange(10)}", rng.choice(["One ", "one", "two", None, "three"]), [f"s/{rng.randrange(10)}" for _ in range(rng.randrange(3))], rng.random() < 0.1, rng.choice([None, None, None, "timeout"]), rng.randrange(100) * 10 + i) for i in range(6)]
        for r in rows:
            if r[1] not in now or r[6] >= now[r[1]][6]:
                now[r[1]] = r
        rules.take(spark.createDataFrame(rows, groups.PAGE), batch)
        if batch == 2:
            rules.take(spark.createDataFrame(rows, groups.PAGE), batch)
        titles = Counter(r[2].strip().lower() for r in now.values() if r[2])
        linked = {t for r in now.values() for t in r[3]}
        ok = [r for r in now.values() if not r[4] and not r[5]]
        want = [("duplicate-title", r[1]) for r in ok if r[2] and titles[r[2].strip().lower()] > 1]
        want += [("orphan-sitemap-page", r[1]) for r in ok if r[1] not in linked and int(r[1][2:]) < 8]
        assert Counter((r.rule, r.url) for r in rules.findings(listed).collect()) == Counter(want)


def test_robots_tables(spark):
    """Random files and paths: as the row-wise parser and matcher judge them."""
    import re

    rng = random.Random(6)
    agents, paths = ["*", "auditor", "Auditor/2", "other", "", "AUDIT"], ["/", "/a", "/a/b", "/*b", "/a$", "/a*c$", "/a.b", "", "*", "/a+", "/ä", "$"]
    files = []
    for site in range(60):
        lines = []
        for _ in range(rng.randrange(12)):
            lines.append(rng.choice(["User-agent: {}", "user-agent:{} # x", "Disallow: {}", "Allow: {} ", " DISALLOW :{}", "junk {}", "", "Sitemap: {}"]).format(rng.choice(agents if rng.random() < 0.4 else paths)))
        files.append((f"s{site}", rng.choice(["", "﻿"]) + rng.choice(["\n", "\r\n"]).join(lines)))
    files += [("none", None), ("odd", "User-agent: *\x0bDisallow: /a\nDisallow: /a/b c")]
    rules = robots.rules_table(spark.createDataFrame(files, "site string, body string"), "Auditor/1.0")
    want = {site: robots.parse_robots(body, "Auditor/1.0") for site, body in files}
    assert Counter((r.site, r.kind, r.pattern) for r in rules.collect()) == Counter((s, *r) for s, found in want.items() for r in found)
    asked = [(s, f"u{i}", p) for s, _ in files for i, p in enumerate(["/", "/a", "/a/b", "/xb", "/abc", "/a.b", "/a+", "/ä?x=1", "/axc$"])]
    got = {(r.site, r.path): r.allowed for r in robots.judge(spark.createDataFrame(asked, "site string, url string, path string"), rules).collect()}
    for site, _, path in asked:
        best = {k: max((len(p) for kind, p in want[site] if kind == k and re.search(robots.pattern_regex(p), path)), default=-1) for k in ("allow", "disallow")}
        assert got[site, path] == (best["allow"] >= best["disallow"]), (site, path, want[site])
    assert len(got) == len(asked)


def test_suppressions_as_a_table(spark):
    """Random patterns, with and without dates: as the policy's own expression."""
    rng = random.Random(5)
    urls = [None, "https://a.example.org/", *[f"https://a.example.org/{x}/{y}" for x in ("en", "de", "e.n") for y in ("1", "12?q=1", "a/b", "(x)")]]
    issues = spark.createDataFrame([("s", r, u, f"{r}{u}") for r in ("one", "two") for u in urls], "snapshot_id string, rule string, url string, fingerprint string")
    patterns = ["/en/*", "/en/**", "**", "/*/1", "https://a.example.org/*", "https://a.example.org/e.n/**", "/", "/en/(x)", "*", "/e?n/*", "/de/a/b", "***/b", "https://a.example.org/en/12?q=1"]
    for _ in range(25):
        rows = [{"rule": rng.choice(["one", "two"]), "url_pattern": p, "expires_at": rng.choice([None, date(2026, 12, 31), date(2027, 1, 1), date(2027, 5, 1)])} for p in rng.sample(patterns, 3)]
        given = spark.createDataFrame([(r["rule"], r["url_pattern"], r["expires_at"]) for r in rows] + [(None, "**", None), ("one", None, None)], "rule string, url_pattern string, expires_at date")
        want = policy.Policy(suppressions=rows, today=date(2027, 1, 1)).apply(issues)
        assert sorted(r.fingerprint for r in policy.suppress(issues, given, date(2027, 1, 1)).collect()) == sorted(r.fingerprint for r in want.collect())
    assert policy.suppress(issues, given.limit(0)).count() == issues.count()


def test_texts_meet_only_patterns_whose_whole_beginning_they_have(spark):
    """Long beginnings of the same length and start: pairs grow with the rows, not with their square."""
    n = 300
    texts = spark.range(n).select(F.lit("r").alias("rule"), F.concat(F.lit("https://a.example.org/en/page-"), F.col("id") + 1000).alias("url"))
    globs = texts.select("rule", F.concat("url", F.lit("**")).alias("p")).unionAll(spark.createDataFrame([("r", "**9"), ("other", "https://a**")], "rule string, p string"))
    known = globs.select("rule", "p", patterns.pattern_key(F.col("p")).alias("_key"), patterns.salts().alias("_salt"))
    met = patterns.keyed(texts, known, "rule", "url", "url").join(known, ["rule", "_key", "_salt"])
    assert met.filter("_key != ''").count() == met.filter("_key = ''").count() == n
    none = patterns.keyed(texts.withColumn("rule", F.lit("none")), known, "rule", "url", "url")
    assert none.count() == none.filter("_key is null").count() == n


def test_rank_and_pages(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 3).alias("y"))
    got = order.with_rank(rows, F.col("y").desc(), F.col("x")).collect()
    assert [(r.y, r.x) for r in sorted(got, key=lambda r: r["rank"])] == sorted(((r.y, r.x) for r in got), key=lambda r: (-r[0], r[1]))
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))
    fifty = order.page(rows, 50, 100, F.col("x"))
    assert sorted(r.x for r in fifty.collect()) == list(range(4900, 5000))
    assert order.with_rank(rows.limit(0), F.col("x")).count() == 0


@pytest.mark.parametrize("page", ["<![abc[x]]> <p>a <a href='/b'>", "<![", "<!", "<![CDATA[ x ]]><p>a</p><a href=/b>", "<!DOCTYPE [ <p>a", "<a href='/b'><?php x", "<script type='application/ld+json'>" + "[" * 200_000 + "</script><a href='/b'>a", "<a href='/b'>" + "<div>" * 50_000])
def test_odd_pages_end_no_job(page):
    out = html.extract(page, "https://example.org/")
    assert out["links"] == (["https://example.org/b"] if "/b" in page else [])


def test_random_bytes_as_pages():
    rng = random.Random(1)
    parts = ["<", ">", "<!", "<![", "]]>", "--", "<!--", "&", "&#", "&#x110000;", "<title>", "</title>", "<script>", "</script", "'", '"', "=", "/", "\x00", "é", "<a href=", "<h1 ", "<?", "<!DOCTYPE", "[", "x" * 5, " "]
    for _ in range(3000):
        html.extract("".join(rng.choice(parts) for _ in range(rng.randrange(30))), rng.choice(["https://example.org/", None, "x"]))
