"""robots.txt: text to rules, and which paths they allow."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import patterns


def parse_robots(body: str | None, agent: str) -> list[tuple[str, str]]:
    """(type, path) rules for ``agent``: those of groups that name it, else of "*"."""
    named: list[tuple[str, str]] = []
    general: list[tuple[str, str]] = []
    agents: list[str] = []
    open_, specific = True, False
    for line in (body or "").removeprefix("\ufeff").replace("\r\n", "\n").split("\n"):
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            agents = [*agents, value.lower()] if open_ else [value.lower()]
            open_ = True
            specific |= bool(value) and value != "*" and value.lower() in agent.lower()
        elif key in ("allow", "disallow"):
            if value:  # a directive without a path does not end the lines of agents
                open_ = False
                if any(a and a != "*" and a in agent.lower() for a in agents):
                    named.append((key, value))
                elif "*" in agents:
                    general.append((key, value))
    return named if specific else general


def pattern_regex(pattern: str) -> str:
    """A path pattern as a regular expression from the start of the path: ``*`` is anything, a last ``$`` the end."""
    end = pattern.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in (pattern[:-1] if end else pattern).split("*")) + ("$" if end else "")


def allowed(path: Column, rules: list[tuple[str, str]], deny_all: bool = False) -> Column:
    """Whether ``path`` (with query) may be fetched: the longest matching pattern decides, allow on a tie or without one."""
    if deny_all:
        return F.lit(False)
    longest = lambda kind: F.greatest(F.lit(-1), F.lit(-1), *[F.when(path.rlike(pattern_regex(p)), len(p)).otherwise(-1) for k, p in rules if k == kind])
    return longest("allow") >= longest("disallow")


def sitemap_lines(body: Column) -> Column:
    """Locations of Sitemap lines, in order."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), 1), lambda x: x)


def with_robots(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    from ..functions.urls import path_and_query

    return pages.withColumn("allowed", allowed(path_and_query(F.col(url)), rules))


def rules_table(files: DataFrame, agent: str) -> DataFrame:
    """(site, kind, pattern) of the rules that hold for ``agent``, from ``files`` (site, body: the text of robots.txt).

    Like ``parse_robots``, for any number of sites: lines are rows, and the groups that they form are numbered by a
    running sum, a group beginning at a User-agent line that follows a rule. A site without rules has no row.
    """
    body = F.regexp_replace(F.coalesce("body", F.lit("")), "^\\uFEFF", "")
    lines = files.select("site", F.posexplode(F.split(body, "\r?\n")).alias("nr", "line"))
    text = F.substring_index("line", "#", 1)
    lines = lines.select("site", "nr", F.lower(F.regexp_replace(F.substring_index(text, ":", 1), r"^\s+|\s+$", "")).alias("key"), F.regexp_replace(F.substring(text, F.instr(text, ":") + 1, F.length(text)), r"^\s+|\s+$", "").alias("value"), F.contains(text, F.lit(":")).alias("has"))
    agents, rules = F.col("key") == "user-agent", F.col("key").isin("allow", "disallow") & (F.col("value") != "")
    in_file = Window.partitionBy("site").orderBy("nr")
    lines = lines.filter(F.col("has") & (agents | rules)).withColumn("begins", agents & ~F.coalesce(F.lag(agents).over(in_file), F.lit(True)))
    lines = lines.withColumn("group", F.sum(F.col("begins").cast("int")).over(in_file))
    name = F.lower("value")
    named = agents & (name != "") & (name != "*") & F.contains(F.lit(agent.lower()), name)
    group = Window.partitionBy("site", "group")
    whole = Window.partitionBy("site")
    lines = lines.withColumn("named", F.max(named).over(group)).withColumn("general", F.max(agents & (name == "*")).over(group)).withColumn("specific", F.max(named).over(whole))
    held = rules & F.when(F.col("specific"), F.col("named")).otherwise(F.col("general") & ~F.col("named"))
    return lines.filter(held).select("site", F.col("key").alias("kind"), F.col("value").alias("pattern"))


def judge(pages: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """``pages`` (site, url, path with query; one row for each site and url) with ``allowed``, by ``rules`` (site, kind, pattern).

    The longest pattern that matches decides; allow on a tie or without one. Rules and pages meet by site and the
    literal beginning of the pattern; a site of any size is dealt to several tasks.
    """
    known = rules.distinct().select("site", "kind", F.length("pattern").alias("size"), patterns.path_pattern(F.col("pattern")).alias("regex"), patterns.pattern_key(F.col("pattern"), True).alias("_key"), patterns.salts().alias("_salt"))
    met = patterns.keyed(pages, known, "site", path, "url").join(known, ["site", "_key", "_salt"], "left").withColumn("hit", F.expr(f"{path} rlike regex"))
    longest = lambda kind: F.coalesce(F.max(F.when(F.col("hit") & (F.col("kind") == kind), F.col("size"))), F.lit(-1))
    return met.groupBy(*pages.columns).agg((longest("allow") >= longest("disallow")).alias("allowed"))


def query(spark, sf_dir: str) -> DataFrame:
    """All pages against the robots.txt of their sites: four kinds of files, each with a rule of its own for one page."""
    from ..functions.urls import normalize_url, origin, path_and_query

    raw = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = raw.select("page_id", origin(F.col("url")).alias("site"), "url", path_and_query(F.col("url")).alias("path")).filter("site is not null")
    first = pages.groupBy("site").agg(F.min(F.struct("page_id", "path")).alias("first")).select("site", (F.col("first.page_id") % 4).alias("n"), F.col("first.path").alias("own"))
    bodies = F.array(*[F.lit(b) for b in BODIES])
    files = first.select("site", F.concat(F.element_at(bodies, (F.col("n") + 1).cast("int")), F.lit("\nUser-agent: *\nDisallow: "), "own", F.lit("\n")).alias("body"))
    judged = judge(pages.select("site", "url", "path").distinct(), rules_table(files, "Auditor/1.0"))
    return judged.select("site", "url", "allowed")


#: robots.txt files of the query.
BODIES = (
    "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\n",
    "User-agent: auditor\r\nDisallow: /de/\r\nAllow: /de/*7\r\n\r\nUser-agent: *\r\nDisallow: /\r\n",
    "# no group yet\nDisallow: /\nUser-agent: x\nUser-agent: *\nDisallow: /fr/*2 # some\nAllow:\nUser-agent: y\nDisallow: /\n",
    "Sitemap: https://example.org/s.xml\nno rule\nUser-agent:\nDisallow: /es/\n\nUSER-AGENT : *\n disallow : /*?\n",
)
