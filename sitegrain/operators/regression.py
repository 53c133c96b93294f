"""Rules on what changed between two snapshots of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import empty, has_directive
from ..functions.urls import origin
from .catalog import with_rule_fields


#: What is compared of two states of a page; nothing else of it is moved.
COMPARED = ["status", "blocked", "error", "robots", "x_robots", "title", "description", "canonical", "h1_count", "final_url"]


def _changed(rule: str, message: Column | str, before: Column, after: Column, severity: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(rule).alias("rule"), (F.lit(message) if isinstance(message, str) else message).alias("message"), (null if severity is None else severity).alias("severity"), before.cast("string").alias("before"), after.cast("string").alias("after"),
        F.to_json(F.struct(before.alias("before"), after.alias("after"), after.alias("actual")), {"ignoreNullFields": "false"}).alias("evidence"), F.lit("null").alias("identity"),
    )


def regressions(before: DataFrame, after: DataFrame, sites_before: DataFrame, sites_after: DataFrame, policy=None) -> DataFrame:
    """Issues (snapshot_id, url, rule, message, severity, before, after, evidence, ...) of ``after`` against ``before``.

    Sites need robots_url, robots_sha, sitemap_url, site_url, sitemap_count and complete. Pages that are blocked
    or fail now, but did not before, have that finding only.
    """
    from .policy import Policy

    old, new = (df.select("snapshot_id", "url", F.struct(*COMPARED).alias(n)) for df, n in ((before, "b"), (after, "a")))
    sites = sites_after.select("snapshot_id", "complete")
    pairs = old.join(new, ["snapshot_id", "url"], "left").join(sites, "snapshot_id")
    b, a = (lambda name: F.col(f"b.{name}")), (lambda name: F.col(f"a.{name}"))
    gone = F.col("a").isNull()
    blocked = ~gone & F.coalesce(a("blocked"), F.lit(False)) & ~F.coalesce(b("blocked"), F.lit(False))
    fails = ~gone & ~blocked & ~empty(a("error")) & empty(b("error"))
    loop = F.contains(F.coalesce(a("error"), F.lit("")), F.lit("redirect loop"))
    go = ~gone & ~blocked & ~fails
    had, has = (lambda n: ~empty(b(n))), (lambda n: ~empty(a(n)))
    robots = lambda x: F.concat(F.coalesce(x("robots"), F.lit("")), F.lit(","), F.coalesce(x("x_robots"), F.lit("")))
    away = lambda n: F.when(origin(a(n)) != origin(F.col("url")), F.lit("error"))
    failure = F.concat(F.lit("Page request failed: "), a("error"))
    # The messages.
    rules = [
        (gone & F.col("complete"), _changed("page-missing", "Page was not checked", b("status"), F.lit(None).cast("int"))),
        (blocked, _changed("robots-blocked", "Page is now blocked by robots.txt", F.lit(False), F.lit(True))),
        (fails & loop, _changed("redirect-loop", failure, b("error"), a("error"))),
        (fails & ~loop, _changed("page-unreachable", failure, b("error"), a("error"))),
        (go & (b("status") < 400) & (F.coalesce(a("status"), F.lit(500)) >= 400), _changed("status-regression", F.concat(F.lit("HTTP status regressed from "), b("status").cast("string"), F.lit(" to "), F.coalesce(a("status").cast("string"), F.lit("none"))), b("status"), a("status"))),
        (go & ~has_directive(robots(b), "noindex") & has_directive(robots(a), "noindex"), _changed("new-noindex", "Page now contains a noindex directive", robots(b), robots(a))),
        (go & had("title") & ~has("title"), _changed("title-removed", "Page title was removed", b("title"), a("title"))),
        (go & had("title") & has("title") & (b("title") != a("title")), _changed("title-changed", "Page title changed", b("title"), a("title"))),
        (go & had("description") & ~has("description"), _changed("description-removed", "Meta description was removed", b("description"), a("description"))),
        (go & had("canonical") & ~has("canonical"), _changed("canonical-removed", "Canonical URL was removed", b("canonical"), a("canonical"))),
        (go & had("canonical") & has("canonical") & (b("canonical") != a("canonical")), _changed("canonical-changed", "Canonical URL changed", b("canonical"), a("canonical"), away("canonical"))),
        (go & (b("h1_count") > 0) & (a("h1_count") == 0), _changed("h1-removed", "All H1 headings were removed", b("h1_count"), a("h1_count"))),
        (go & had("final_url") & has("final_url") & (b("final_url") != a("final_url")), _changed("redirect-changed", "Final redirect URL changed", b("final_url"), a("final_url"), away("final_url"))),
    ]
    found = pairs.select("snapshot_id", "url", F.explode(F.filter(F.array(*[F.when(w, x) for w, x in rules]), lambda x: x.isNotNull())).alias("f")).select("snapshot_id", "url", "f.*")
    both = sites_before.select("snapshot_id", *[F.col(c).alias(f"_{c}") for c in ("robots_sha", "sitemap_count", "sitemap_url")]).join(sites_after, "snapshot_id")
    drop = F.col("_sitemap_count") - F.col("sitemap_count")
    site_rules = [
        (~empty(F.col("_robots_sha")) & ~empty(F.col("robots_sha")) & (F.col("_robots_sha") != F.col("robots_sha")), F.col("robots_url"), _changed("robots-changed", "robots.txt content changed", F.col("_robots_sha"), F.col("robots_sha"))),
        (F.col("complete") & (F.col("_sitemap_count") > 0) & (drop >= F.greatest(F.lit(5), F.ceil(F.col("_sitemap_count") * F.expr("0.2D")))), F.coalesce("sitemap_url", "_sitemap_url", "site_url"), _changed("sitemap-url-count-drop", F.concat(F.lit("Sitemap URL count dropped by "), drop.cast("string")), F.col("_sitemap_count"), F.col("sitemap_count"))),
    ]
    for when, url, change in site_rules:
        found = found.unionByName(both.filter(when).select("snapshot_id", url.alias("url"), change.alias("f")).select("snapshot_id", "url", "f.*"))
    return (policy or Policy()).apply(with_rule_fields(found))
