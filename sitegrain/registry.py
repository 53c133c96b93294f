"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text, urls
from .operators import catalog, current, diff, graph, order, policy, regression, report
from .plans import crawl, site_scan
from .sources import checkpoint, html, robots, site_tables, sitemap, sitemap_index
from .streaming import groups, lifecycle, page_table, replay

ISSUE = ["snapshot_id", "rule", "severity", "scope", "owner", "url", "fingerprint", "message"]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _audit(spark, sf_dir, enabled=None, shift=0, **options) -> DataFrame:
    s = site_tables.snapshot(spark, sf_dir, shift)
    return current.audit(s.pages, s.sites, s.sitemap_urls, policy.Policy(enabled=enabled, **options), with_urls=False).select(ISSUE)


def _rule(rule: str):
    return lambda spark, sf_dir: _audit(spark, sf_dir, [rule])


def _regressions(spark, sf_dir, enabled=None) -> DataFrame:
    b, a = site_tables.snapshot(spark, sf_dir, 1), site_tables.snapshot(spark, sf_dir, 0)
    return regression.regressions(b.pages, a.pages, b.sites, a.sites, policy.Policy(enabled=enabled)).select(*ISSUE, "before", "after")


def _regression(rule: str):
    return lambda spark, sf_dir: _regressions(spark, sf_dir, [rule])


def _diff(spark, sf_dir) -> DataFrame:
    b, a = site_tables.snapshot(spark, sf_dir, 1), site_tables.snapshot(spark, sf_dir, 0)
    old, new = (current.audit(s.pages, s.sites, s.sitemap_urls, with_urls=False) for s in (b, a))
    changed = regression.regressions(b.pages, a.pages, b.sites, a.sites)
    return diff.diff(old, new, a.pages.select("snapshot_id", "url"), a.sites, changed)


def f1_normalize_url(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.normalize_url(F.col("url")).alias("url"), urls.normalize_url(F.col("url"), True).alias("with_query"))


def f2_origin(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.origin(F.col("url")).alias("origin"), urls.same_origin(F.col("url"), F.lit("https://www.thering.example.org")).alias("same"))


def f3_crawlable(spark, sf_dir):
    variants = F.concat("url", F.element_at(F.array(*map(F.lit, ("", ".pdf", ".PNG", ".html"))), (F.col("page_id") % 4 + 1).cast("int")))
    return _pages(spark, sf_dir).select("page_id", urls.is_crawlable(variants).alias("crawlable"))


def f4_map_origin(spark, sf_dir):
    url = urls.normalize_url(F.col("url"))
    return _pages(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 2 == 0, urls.map_origin(url, urls.origin(url), F.lit("https://preview.example.org"))).otherwise(urls.map_origin(url, F.lit("http://none.example.org"), F.lit("https://preview.example.org"))).alias("url"))


def f5_map_prefix(spark, sf_dir):
    url = urls.normalize_url(F.col("url"))
    return _pages(spark, sf_dir).select("page_id", urls.map_origin(url, urls.origin(url), F.lit("https://preview.example.org"), F.lit("/sub/")).alias("url"))


def f6_clean_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


def f7_has_directive(spark, sf_dir):
    value = F.element_at(F.array(*map(F.lit, ("noindex", "noindexed", "follow, NOINDEX", "all noindex,x", "nofollow"))), (F.col("page_id") % 5 + 1).cast("int"))
    return _pages(spark, sf_dir).select("page_id", text.has_directive(value, "noindex").alias("noindex"))


def f8_valid_language(spark, sf_dir):
    tag = F.element_at(F.array(*map(F.lit, ("en", "en-US", "x-default", "en_US", "zh-Hant-TW", "abcd", "de-1996", "sr-Latn-RS-x-y"))), (F.col("page_id") % 8 + 1).cast("int"))
    return _pages(spark, sf_dir).select("page_id", text.valid_language(tag).alias("valid"))


#: Rules of the robots query.
ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\n\nUser-agent: other\nDisallow: /"


def f10_robots_allowed(spark, sf_dir):
    return robots.with_robots(_pages(spark, sf_dir), robots.parse_robots(ROBOTS, "auditor")).select("page_id", "allowed")


def f12_content_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.content_hash(text.clean_text(F.col("text"))).alias("content_hash"))


def f13_word_count(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.word_count(text.clean_text(F.col("text"))).cast("long").alias("n_words"))


def f15_fingerprint(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.fingerprint(F.lit("missing-title"), F.lit("page"), F.col("url"), F.lit("null")).alias("fingerprint"))


def h_extract(spark, sf_dir):
    out = html.extract_pages(_pages(spark, sf_dir).select("page_id", "url", "html"))
    return out.select("page_id", "title", "lang", F.col("h1_count").cast("long").alias("h1_count"), F.col("word_count").cast("long").alias("n_words"), "content_hash", F.size("links").cast("long").alias("n_links"), F.size("external_links").cast("long").alias("n_external"))


def s12_sitemap_parse(spark, sf_dir):
    p = _pages(spark, sf_dir).select(urls.origin(F.col("url")).alias("site"), "page_id", urls.normalize_url(F.col("url")).alias("url"))
    entry = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>"))
    xml = p.groupBy("site", (F.col("page_id") % 16).alias("part")).agg(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    return sitemap.sitemap_urls(xml)


def a1_duplicate_content(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = text.content_hash(text.clean_text(F.col("text")))
    hashed = docs.select("doc_id", key.alias("content_hash"))
    # The count leaves out null hashes: a filter on the hash would be pushed to the texts and compute it again.
    return hashed.groupBy("content_hash").agg(F.count("content_hash").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


def a2_statistics(spark, sf_dir):
    return graph.statistics(site_tables.snapshot(spark, sf_dir).pages)


def a3_link_graph(spark, sf_dir):
    s = site_tables.snapshot(spark, sf_dir)
    return graph.link_graph(s.pages, s.sitemap_urls)


def a4_health(spark, sf_dir):
    return graph.health(site_tables.snapshot(spark, sf_dir).pages)


def a5_severity_summary(spark, sf_dir):
    return _audit(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("url").alias("pages"))


def a7_budgets(spark, sf_dir):
    return diff.budget_exceeded(_diff(spark, sf_dir), {"error": 1, "title-changed": 0, "noindex": 1000}).select("snapshot_id", "budget", F.col("allowed").cast("long").alias("allowed"), "actual")


def j5_orphans(spark, sf_dir):
    s = site_tables.snapshot(spark, sf_dir)
    return graph.orphans(s.pages, s.sitemap_urls)


def c1_audit(spark, sf_dir):
    return _audit(spark, sf_dir)


def c2_regressions(spark, sf_dir):
    return _regressions(spark, sf_dir)


def c3_diff_lifecycle(spark, sf_dir):
    b, a = site_tables.snapshot(spark, sf_dir, 1), site_tables.snapshot(spark, sf_dir, 0)
    # Audits are stored one by one: a plan of all of them takes much of the driver's memory. Evidence has digests of groups, and only ongoing issues need the URLs.
    old, new = (crawl.stored(current.audit(s.pages, s.sites, s.sitemap_urls, with_urls=False).select(*ISSUE, "evidence"), "audit") for s in (b, a))
    changed = crawl.stored(regression.regressions(b.pages, a.pages, b.sites, a.sites).select(*ISSUE, "before", "after"), "regressions")
    rows = crawl.stored(diff.diff(old, new, a.pages.select("snapshot_id", "url"), a.sites, changed), "diff")
    ongoing = F.col("lifecycle") == "ongoing"
    filled = current.with_group_urls(rows.filter(ongoing), {"before": b.pages, "after": a.pages})
    return rows.filter(~ongoing).unionByName(filled).select(*diff.FIELDS, (ongoing & F.col("before").isNotNull()).alias("has_both"))


def s21_lifecycle_summary(spark, sf_dir):
    return report.lifecycle_counts(_diff(spark, sf_dir))


def a8_rule_list(spark, sf_dir):
    return report.rule_labels(_audit(spark, sf_dir))


def c4_policy(spark, sf_dir):
    return _audit(spark, sf_dir, ["noindex", "missing-canonical"], overrides={"noindex": "error"}, suppressions=[{"rule": "missing-canonical", "url_pattern": "/en/**"}])


def c14_gate(spark, sf_dir):
    issues = _audit(spark, sf_dir)
    return issues.groupBy("snapshot_id").agg(F.max(policy.blocks(F.col("severity"), "error")).alias("blocked"))


def c14_gate_budgets(spark, sf_dir):
    """Gate of all sites: an error among new findings, or a budget that is exceeded."""
    return diff.gate(_diff(spark, sf_dir), "error", {"warning": 3, "title-changed": 0})


def f17_html_escape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", report.escape_html(F.col("text")).alias("escaped"))


def f22_report_filter(spark, sf_dir):
    return report.matching(_audit(spark, sf_dir), severity="error", owner="developer", query=" EXAMPLE.org/En ")


def s21_summary(spark, sf_dir):
    return report.summary(_audit(spark, sf_dir), "error")


def s20_csv_lines(spark, sf_dir):
    return report.csv_lines(report.with_defaults(_audit(spark, sf_dir)))


def l2_crawl(spark, sf_dir):
    return crawl.query(spark, sf_dir)


def c11_scan(spark, sf_dir):
    return site_scan.query(spark, sf_dir)


def s15_checkpoint_last(spark, sf_dir):
    return checkpoint.query(spark, sf_dir)


def st_replay(spark, sf_dir):
    return replay.query(spark, sf_dir)


def j15_suppressions(spark, sf_dir):
    """All findings against four suppressions for each page."""
    k = F.col("page_id")
    path = F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1)
    made = [("missing-open-graph", F.concat(path, F.lit("**")), F.lit(None).cast("date")), ("missing-twitter-metadata", F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.lit("*")), F.make_date(2026 + k % 3, F.lit(6), F.lit(30)))]
    made += [("low-word-count", F.regexp_replace(path, "[0-9]", "*"), F.make_date(2026 + k % 2, F.lit(12), F.lit(31))), ("missing-canonical", F.concat(F.lit("**"), F.substring(path, -2, 2)), F.lit(None).cast("date"))]
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), p.alias("url_pattern"), d.alias("expires_at")) for r, p, d in made])
    suppressions = _pages(spark, sf_dir).select(F.explode(rows).alias("s")).select("s.*")
    return policy.suppress(_audit(spark, sf_dir), suppressions, date(2027, 1, 1))


def j16_robots_tables(spark, sf_dir):
    return robots.query(spark, sf_dir)


def s10_sitemap_index(spark, sf_dir):
    return sitemap_index.query(spark, sf_dir)


def o1_issue_rank(spark, sf_dir):
    """All findings numbered by severity, URL, rule, fingerprint and site, and the page of 100 that each is on."""
    by = [policy.severity_rank(F.col("severity")), F.col("url"), F.col("rule"), F.col("fingerprint"), F.col("snapshot_id")]
    return order.with_rank(_audit(spark, sf_dir), *by).select("snapshot_id", "fingerprint", "rule", "url", "rank", F.ceil(F.col("rank") / 100).alias("page"))


def st1_page_table(spark, sf_dir):
    return page_table.query(spark, sf_dir)


def st4_group_rules(spark, sf_dir):
    return groups.query(spark, sf_dir)


def st5_lifecycle(spark, sf_dir):
    return lifecycle.query(spark, sf_dir)


def queries() -> dict:
    out = {f.__name__: f for f in (
        c1_audit, c2_regressions, c3_diff_lifecycle, c4_policy, c14_gate, c14_gate_budgets, f1_normalize_url, f2_origin, f3_crawlable, f4_map_origin, f5_map_prefix, f6_clean_text, f7_has_directive, f8_valid_language,
        f10_robots_allowed, f12_content_hash, f13_word_count, f15_fingerprint, h_extract, s12_sitemap_parse, a1_duplicate_content, a2_statistics, a3_link_graph, a4_health, a5_severity_summary, a7_budgets,
        f17_html_escape, s21_lifecycle_summary, a8_rule_list, f22_report_filter, s20_csv_lines, s21_summary, j5_orphans, l2_crawl, c11_scan, s15_checkpoint_last, st_replay, j15_suppressions, j16_robots_tables, s10_sitemap_index, o1_issue_rank, st1_page_table, st4_group_rules, st5_lifecycle,
    )}
    out |= {f"r{i:02d}_{r.replace('-', '_')}": _rule(r) for i, r in enumerate(catalog.CURRENT, 1)}
    out |= {f"r{i:02d}_{r.replace('-', '_')}": _regression(r) for i, r in enumerate(catalog.REGRESSION, 35)}
    return out


def oracle_sql() -> dict:
    from .oracle import sql

    return sql()
