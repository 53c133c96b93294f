"""Reports of issues: defaults, filters and slices as columns; CSV, JSON summary and HTML."""

from __future__ import annotations

import html
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from .policy import blocks, ordered

#: Defaults of fields that an issue can lack, and the columns of the CSV export.
DEFAULTS = {"fingerprint": "legacy", "severity": "info", "scope": "page", "url": "", "message": "", "owner": "seo", "remediation": "Review the finding and confirm the intended behavior.", "lifecycle": "current"}
CSV = ["severity", "lifecycle", "rule", "owner", "url", "message", "before", "after", "remediation", "fingerprint"]
RENDERED = ("evidence", "before", "after")
SEARCHED = ["url", "rule", "message", "owner", "evidence", "before", "after"]


def _column(issues: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in issues.columns else F.lit(None).cast("string")


def with_defaults(issues: DataFrame) -> DataFrame:
    """All fields of a report's issue; missing columns and nulls get the defaults. ``rule`` and ``rule_id`` stand in for each other."""
    rule = F.coalesce(_column(issues, "rule"), _column(issues, "rule_id"), F.lit("unknown"))
    keep = [_column(issues, c).alias(c) for c in ("snapshot_id", "before", "after")]
    evidence = F.coalesce(_column(issues, "evidence"), F.to_json(F.struct(_column(issues, "after").alias("actual"))))
    return issues.select(*keep, rule.alias("rule"), evidence.alias("evidence"), *[F.coalesce(_column(issues, c), F.lit(d)).alias(c) for c, d in DEFAULTS.items()])


def matching(issues: DataFrame, lifecycle: str = "", severity: str = "", rule: str = "", owner: str = "", query: str = "") -> DataFrame:
    """Issues that fit all filters given; ``query`` is looked for in seven fields, whatever its case."""
    for name, value in (("lifecycle", lifecycle), ("severity", severity), ("rule", rule), ("owner", owner)):
        if value:
            issues = issues.filter(F.col(name) == value)
    if query.strip():
        text = F.concat_ws(" ", *[_shown(issues, c) for c in SEARCHED])
        issues = issues.filter(F.contains(F.lower(text), F.lit(query.strip().lower())))
    return issues


def _shown(issues: DataFrame, name: str) -> Column:
    """A field as a report shows it; values that are missing or empty have words for that, which can be searched too."""
    if name not in RENDERED:
        return F.coalesce(_column(issues, name), F.lit(""))
    return F.when(F.coalesce(_column(issues, name), F.lit("")) == "", "Not present").otherwise(_column(issues, name)) if name in issues.columns else F.lit("—")


def rule_labels(issues: DataFrame) -> DataFrame:
    """(rule, label) of the rules that occur, each once, in order: the choices of a report's rule filter."""
    text = F.replace("rule", F.lit("-"), F.lit(" "))
    return issues.select("rule").distinct().select("rule", F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2))).alias("label")).orderBy("rule")


def lifecycle_counts(issues: DataFrame) -> DataFrame:
    """One row per snapshot: numbers of new, ongoing, unchanged and resolved issues, and of the current ones (new and ongoing)."""
    states = ("new", "ongoing", "unchanged", "resolved")
    counts = issues.groupBy("snapshot_id").agg(*[F.count_if(F.col("lifecycle") == s).alias(s) for s in states])
    return counts.withColumn("current", F.col("new") + F.col("ongoing"))


def page_of(issues: DataFrame, number: int, size: int = 100) -> DataFrame:
    """Page ``number`` (from 1) of the issues in report order."""
    return ordered(issues).offset((max(number, 1) - 1) * size).limit(size)


def top(issues: DataFrame, n: int = 25) -> DataFrame:
    return ordered(issues).limit(n)


def escape_html(x: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def safe_json(value: object) -> str:
    """JSON that can stand in a script element."""
    text = json.dumps(value, ensure_ascii=False)
    for char in "<>&":
        text = text.replace(char, f"\\u{ord(char):04x}")
    return text


def csv_lines(issues: DataFrame) -> DataFrame:
    """One column ``value``: each issue as a line, every field quoted. Write it with ``text``; the header is ``",".join(CSV)``."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(_column(issues, c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in CSV]
    return issues.select(F.concat_ws(",", *quoted).alias("value"))


def summary(issues: DataFrame, threshold: str = "error") -> DataFrame:
    """One row per snapshot: errors, warnings, infos, affected (pages with issues), blocked (by the gate)."""
    counts = [F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))]
    return issues.groupBy("snapshot_id").agg(*counts, F.countDistinct("url").alias("affected"), F.max(blocks(F.col("severity"), threshold)).alias("blocked"))


def escape_text(value: object) -> str:
    return html.escape("" if value is None else str(value)).replace("&#x27;", "&#039;")


def _replace(path: str, write) -> None:
    draft = Path(f"{path}.draft")
    with draft.open("w", encoding="utf-8") as out:
        write(out)
    os.replace(draft, path)


def write_html(issues: DataFrame, path: str, title: str, partial: bool = False, color: str = "#1f5fbf") -> None:
    """A report of all issues in a file at the driver. Rows come partition by partition, so the driver holds few of them."""
    columns = ["severity", "lifecycle", "rule", "owner", "url", "message", "before", "after", "remediation"]
    rows = ordered(with_defaults(issues)).select(columns)

    def write(out):
        name, note = escape_text(title), "<p>Partial result</p>" if partial else ""
        out.write(f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{name}</title><style>h1{{color:{escape_text(color)}}}</style></head><body><h1>{name}</h1>{note}<table><thead><tr>')
        out.write("".join(f"<th>{c}</th>" for c in columns) + "</tr></thead><tbody>\n")
        for row in rows.toLocalIterator():
            out.write("<tr>" + "".join(f"<td>{escape_text(x)}</td>" for x in row) + "</tr>\n")
        out.write("</tbody></table></body></html>\n")

    _replace(path, write)
