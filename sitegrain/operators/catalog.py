"""The rules: id, severity, owner, scope and remediation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rule, severity, owner, scope, remediation.
RULES = [
    ("page-unreachable", "error", "developer", "page", "Restore the page or remove references to it."),
    ("http-error", "error", "developer", "page", "Return a successful response or a deliberate redirect."),
    ("noindex", "info", "seo", "page", "Remove noindex when the page should appear in search."),
    ("x-robots-noindex", "error", "developer", "page", "Remove the noindex X-Robots-Tag when indexing is intended."),
    ("robots-blocked", "error", "developer", "page", "Allow the URL in robots.txt when it should be crawled."),
    ("missing-canonical", "warning", "seo", "page", "Declare the preferred canonical URL when duplicate URL variants are possible."),
    ("invalid-canonical", "error", "developer", "page", "Use an absolute or valid relative HTTP(S) canonical URL."),
    ("cross-domain-canonical", "error", "seo", "page", "Confirm the external canonical or point it to the intended same-site URL."),
    ("canonical-target-error", "error", "developer", "page", "Point the canonical to an accessible, indexable URL."),
    ("redirect-loop", "error", "developer", "page", "Remove the circular redirect path."),
    ("long-redirect-chain", "warning", "developer", "page", "Redirect directly to the final destination."),
    ("sitemap-unavailable", "error", "developer", "site", "Restore a valid, reachable XML sitemap."),
    ("noindex-in-sitemap", "error", "seo", "page", "Remove the URL from the sitemap or make it indexable."),
    ("redirect-in-sitemap", "error", "seo", "page", "Replace the sitemap URL with its final canonical destination."),
    ("missing-title", "error", "content", "page", "Add a unique, descriptive HTML title."),
    ("duplicate-title", "warning", "content", "page", "Write a title that uniquely describes this page."),
    ("title-length", "warning", "content", "page", "Keep the title concise and descriptive, usually 10–60 characters."),
    ("missing-description", "warning", "content", "page", "Add a useful meta description."),
    ("duplicate-description", "warning", "content", "page", "Write a unique meta description for this page."),
    ("description-length", "warning", "content", "page", "Keep the description useful and usually between 50 and 160 characters."),
    ("missing-h1", "warning", "content", "page", "Add one clear primary heading."),
    ("broken-internal-link", "error", "developer", "page", "Update or remove the internal link, or restore its target."),
    ("orphan-sitemap-page", "warning", "seo", "page", "Add meaningful internal links to the sitemap page."),
    ("crawlable-not-in-sitemap", "warning", "seo", "page", "Add the indexable page to the sitemap or intentionally exclude it."),
    ("invalid-hreflang", "warning", "seo", "page", "Use valid language tags and resolvable HTTP(S) alternate URLs."),
    ("malformed-json-ld", "warning", "developer", "page", "Fix JSON syntax in the structured-data block."),
    ("http-on-https-site", "warning", "developer", "page", "Use HTTPS for internal URLs and metadata references."),
    ("invalid-language", "warning", "developer", "page", "Set a valid BCP 47 language tag on the html element."),
    ("duplicate-content", "warning", "content", "page", "Consolidate duplicate pages or differentiate their main content."),
    ("multiple-h1", "info", "content", "page", "Review whether one primary H1 would make the hierarchy clearer."),
    ("missing-open-graph", "info", "content", "page", "Add Open Graph title, description, and image for social sharing."),
    ("missing-twitter-metadata", "info", "content", "page", "Add Twitter card metadata when social previews matter."),
    ("image-missing-alt", "info", "content", "page", "Add meaningful alt text, or an empty alt for decorative images."),
    ("low-word-count", "info", "content", "page", "Review whether the page provides enough useful primary content."),
    ("robots-changed", "warning", "developer", "site", "Review the robots.txt change and confirm that crawl access is intentional."),
    ("page-missing", "error", "developer", "page", "Include the page in the scan or confirm that its removal is intentional."),
    ("status-regression", "error", "developer", "page", "Restore the previous successful HTTP response."),
    ("new-noindex", "error", "seo", "page", "Remove the newly introduced noindex unless it is intentional."),
    ("title-removed", "error", "content", "page", "Restore a descriptive title."),
    ("title-changed", "warning", "content", "page", "Review and approve the changed title."),
    ("description-removed", "warning", "content", "page", "Restore a useful meta description."),
    ("canonical-removed", "error", "seo", "page", "Restore the canonical declaration."),
    ("canonical-changed", "warning", "seo", "page", "Confirm the new canonical target is deliberate and valid."),
    ("h1-removed", "warning", "content", "page", "Restore a clear primary heading."),
    ("redirect-changed", "warning", "developer", "page", "Confirm the new redirect destination is intentional."),
    ("sitemap-url-count-drop", "error", "seo", "site", "Investigate the sitemap URL loss and restore omitted indexable pages."),
]
BY_ID = {r[0]: r for r in RULES}
CURRENT, REGRESSION = [r[0] for r in RULES[:34]], [r[0] for r in RULES[34:]]


def _lookup(rule: Column, n: int) -> Column:
    """A field of the rule, as a literal map: no join."""
    return F.element_at(F.create_map(*[F.lit(x) for r in RULES for x in (r[0], r[n])]), rule)


def with_rule_fields(issues: DataFrame, documentation: str = "") -> DataFrame:
    """Adds severity (unless the issue has one), owner, scope, remediation, documentation_url and fingerprint."""
    from ..functions.text import fingerprint

    rule = F.col("rule")
    out = issues.withColumn("severity", F.coalesce(F.col("severity") if "severity" in issues.columns else F.lit(None), _lookup(rule, 1)))
    out = out.withColumn("owner", _lookup(rule, 2)).withColumn("scope", _lookup(rule, 3)).withColumn("remediation", _lookup(rule, 4))
    out = out.withColumn("documentation_url", F.concat(F.lit(documentation + "#"), rule))
    return out.withColumn("fingerprint", fingerprint(rule, F.col("scope"), F.col("url"), F.col("identity")))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "id string, severity string, owner string, scope string, remediation string")
