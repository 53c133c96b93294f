"""Policies: which rules count, how severe they are, and what is suppressed until when."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns
from ..functions.text import glob_regex
from ..functions.urls import path_and_query


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


@dataclass
class Policy:
    """``enabled`` None: all rules; an empty list: none. ``suppressions``: dicts with rule, url_pattern, expires_at (date or None: never); ``today`` is the date in UTC."""

    enabled: list[str] | None = None
    overrides: dict[str, str] = field(default_factory=dict)
    suppressions: list[dict] = field(default_factory=list)
    today: date = field(default_factory=lambda: datetime.now(UTC).date())

    def suppressed(self) -> Column:
        path = F.regexp_replace(path_and_query(F.col("url")), r"\?.*$", "")
        out = F.lit(False)
        for s in self.suppressions:
            until = s.get("expires_at")
            if until and until < self.today:
                continue
            pattern = glob_regex(s["url_pattern"])
            out = out | ((F.col("rule") == s["rule"]) & (path.rlike(pattern) | F.col("url").rlike(pattern)))
        return out

    def apply(self, issues: DataFrame) -> DataFrame:
        if self.enabled is not None:
            issues = issues.filter(F.col("rule").isin(self.enabled))
        if self.overrides:
            new = F.create_map(*[F.lit(x) for pair in self.overrides.items() for x in pair])
            issues = issues.withColumn("severity", F.coalesce(F.try_element_at(new, F.col("rule")), "severity"))
        return issues.filter(~F.coalesce(self.suppressed(), F.lit(False))) if self.suppressions else issues


def suppress(issues: DataFrame, suppressions: DataFrame, today: date | None = None) -> DataFrame:
    """``issues`` without those that a row of ``suppressions`` (rule, url_pattern, expires_at: date or null) covers, for any number of these.

    A pattern covers an issue of its rule if it matches the URL or its path, until the end of ``expires_at`` (UTC).
    Both meet by rule and the literal beginning of the pattern; rows with a null rule or pattern cover nothing.
    """
    day = F.lit(today or datetime.now(UTC).date())
    valid = suppressions.filter((F.col("expires_at").isNull() | (F.col("expires_at") >= day)) & F.col("url_pattern").isNotNull()).select("rule", "url_pattern").distinct()
    known = valid.select("rule", patterns.pattern_key(F.col("url_pattern")).alias("_key"), patterns.glob(F.col("url_pattern")).alias("_regex"), patterns.salts().alias("_salt"))
    path = F.regexp_replace(path_and_query(F.col("url")), r"\?.*$", "")
    asked = issues.select("rule", "url").distinct().select("rule", "url", F.explode(F.array("url", path)).alias("_text")).filter("_text is not null")
    covered = patterns.keyed(asked, known, "rule", "_text", "url").join(known, ["rule", "_key", "_salt"]).filter("_text rlike _regex").select("rule", "url").distinct()
    return issues.join(covered, ["rule", "url"], "left_anti").select(issues.columns)


def ordered(issues: DataFrame) -> DataFrame:
    """By severity, url, rule, fingerprint; URLs in the order of the root collation."""
    return issues.orderBy(severity_rank(F.col("severity")), F.expr("url COLLATE UNICODE"), F.expr("rule COLLATE UNICODE"), "fingerprint")


def blocks(severity: Column, threshold: str) -> Column:
    """Whether an issue of this severity fails a gate at ``threshold`` (none, warning or error)."""
    if threshold == "none":
        return F.lit(False)
    return severity.isin("error", "warning") if threshold == "warning" else severity == "error"
