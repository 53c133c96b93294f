"""Rules on one snapshot: each page is gone through once, with what joins and groups have to say beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import empty, group_key, has_directive, json_string, utf16_length, valid_language
from ..functions.urls import origin
from .catalog import CURRENT, with_rule_fields
from .graph import failed, orphans

KEY = ["snapshot_id", "url"]


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def _found(rule: str, message: Column | str, evidence: Column, identity: Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(rule).alias("rule"), text.alias("message"), evidence.alias("evidence"), (F.lit("null") if identity is None else identity).alias("identity"))


def _group_keys() -> dict[str, Column]:
    """Keys by which pages are duplicates; null for none."""
    return {"title": group_key(F.col("title")), "description": group_key(F.col("description")), "content": F.when(~empty(F.col("content_hash")), F.col("content_hash"))}


def _groups(pages: DataFrame, key: Column, name: str, with_urls: bool) -> DataFrame:
    """(snapshot_id, key, urls) of keys that several pages share; urls is the list, or one digest of it."""
    grouped = pages.select("snapshot_id", key.alias(f"_{name}"), "url").filter(f"_{name} is not null").groupBy("snapshot_id", f"_{name}")
    urls = F.sort_array(F.collect_list("url"))
    if not with_urls:  # two digests that do not depend on order, so that they are combined before the shuffle
        urls = F.array(*[F.bit_xor(F.xxhash64("url", F.lit(n))).cast("string") for n in (1, 2)], F.count("*").cast("string"))
    return grouped.agg(F.count("*").alias("_n"), urls.alias(f"_{name}_urls")).filter("_n > 1").drop("_n")


def evaluate(pages: DataFrame, sites: DataFrame, sitemap_urls: DataFrame, enabled: list[str] | None = None, with_urls: bool = True) -> DataFrame:
    """Findings (snapshot_id, url, rule, message, evidence, identity) of the rules on the current state.

    ``pages`` has one row for each URL of a snapshot; ``sites``: one row per snapshot with site_url, has_sitemap, sitemap_url, sitemap_error. Only what the
    ``enabled`` rules need is joined; without ``with_urls``, evidence has a digest in place of the URLs of duplicate
    groups, which grow with the square of a group.
    """
    on = set(CURRENT if enabled is None else enabled)
    keys = {name: key for name, key in _group_keys().items() if f"duplicate-{name}" in on}
    # Joins by site, text and target carry narrow rows; whole pages are moved once, by URL.
    marks = pages.select(*KEY, "canonical", *[key.alias(f"_{name}") for name, key in keys.items()]).join(sites.select("snapshot_id", "site_url", "has_sitemap"), "snapshot_id")
    for name, key in keys.items():
        marks = marks.join(_groups(pages, key, name, with_urls), ["snapshot_id", f"_{name}"], "left")
    bad = pages.filter(failed()).select("snapshot_id", F.col("url").alias("_target"), F.coalesce(F.col("status").cast("string"), json_string(F.col("error")), F.lit("null")).alias("_actual"))
    if "canonical-target-error" in on:
        marks = marks.join(bad.withColumnRenamed("_target", "canonical"), ["snapshot_id", "canonical"], "left")
    if on & {"noindex-in-sitemap", "redirect-in-sitemap", "orphan-sitemap-page", "crawlable-not-in-sitemap"}:
        marks = marks.join(sitemap_urls.select(*KEY).distinct().withColumn("_listed", F.lit(True)), KEY, "left")
    if "orphan-sitemap-page" in on:
        marks = marks.join(orphans(pages, sitemap_urls).withColumn("_orphan", F.lit(True)), KEY, "left")
    out = pages.join(marks.drop("canonical"), KEY)
    unused = {"_actual": "string", "_listed": "boolean", "_orphan": "boolean"} | {f"_{n}": "string" for n in ("title", "description", "content")} | {f"_{n}_urls": "array<string>" for n in ("title", "description", "content")}
    out = out.withColumns({c: F.lit(None).cast(kind) for c, kind in unused.items() if c not in out.columns})
    found = out.select("snapshot_id", "url", F.explode(F.filter(F.concat(*_page_rules(on)), lambda x: x.isNotNull())).alias("f")).select("snapshot_id", "url", "f.*")
    if "broken-internal-link" in on:
        links = pages.filter(~F.coalesce("blocked", F.lit(False)) & empty(F.col("error"))).select("snapshot_id", "url", F.explode("internal_links").alias("_target"))
        evidence = F.concat(F.lit('{"target":'), json_string(F.col("_target")), F.lit(',"actual":'), F.col("_actual"), F.lit("}"))
        broken = links.join(bad, ["snapshot_id", "_target"]).select("snapshot_id", "url", _found("broken-internal-link", "Internal link points to an unavailable page", evidence, json_string(F.col("_target"))).alias("f"))
        found = found.unionByName(broken.select("snapshot_id", "url", "f.*"))
    if "sitemap-unavailable" in on:
        down = sites.filter(~empty(F.col("sitemap_error"))).select("snapshot_id", F.col("sitemap_url").alias("url"), _found("sitemap-unavailable", "The configured sitemap could not be loaded", _json(actual=F.col("sitemap_error"))).alias("f"))
        found = found.unionByName(down.select("snapshot_id", "url", "f.*"))
    return found


def _page_rules(on: set[str]) -> list[Column]:
    """Arrays of findings of one page; blocked and failed pages have one finding only."""
    c = F.col
    blocked, error = F.coalesce("blocked", F.lit(False)), ~empty(c("error"))
    ok = ~blocked & ~error
    loop = F.contains(F.coalesce("error", F.lit("")), F.lit("redirect loop"))
    chain, listed = F.size("redirect_chain"), F.coalesce("_listed", F.lit(False))
    noindex, x_noindex = has_directive(c("robots"), "noindex"), has_directive(c("x_robots"), "noindex")
    title, description = ~empty(c("title")), ~empty(c("description"))
    title_n, description_n = utf16_length(c("title")), utf16_length(c("description"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    http = lambda x: F.startswith(F.coalesce(x, F.lit("")), F.lit("http:"))
    refs = F.filter(F.concat(F.array("url", "canonical"), "internal_links"), http)
    no_alt = F.transform(F.filter("images", lambda i: i["alt"].isNull()), lambda i: i["src"])
    incomplete = lambda name, fields: F.lit(False) | F.exists(F.array(*[c(f"{name}.{f}") for f in fields]), empty)
    # The messages.
    one = [
        ("robots-blocked", blocked, "Page is blocked by robots.txt", _json(actual=F.lit(True)), None),
        ("redirect-loop", ~blocked & error & loop, say("Page request failed: ", c("error")), _json(actual=c("error"), redirectChain=c("redirect_chain")), None),
        ("page-unreachable", ~blocked & error & ~loop, say("Page request failed: ", c("error")), _json(actual=c("error"), redirectChain=c("redirect_chain")), None),
        ("http-error", ok & (F.coalesce("status", F.lit(500)) >= 400), say("Page returned HTTP ", F.coalesce(c("status").cast("string"), F.lit("unknown"))), _json(actual=c("status")), None),
        ("noindex", ok & noindex, "Page contains a noindex meta directive", _json(actual=c("robots")), None),
        ("x-robots-noindex", ok & x_noindex, "Page contains a noindex X-Robots-Tag", _json(actual=c("x_robots")), None),
        ("missing-canonical", ok & empty(c("canonical_raw")) & empty(c("canonical")), "Page does not declare a canonical URL", _json(actual=F.lit(None).cast("string")), None),
        ("invalid-canonical", ok & ~empty(c("canonical_raw")) & empty(c("canonical")), "Canonical URL is invalid", _json(actual=c("canonical_raw")), None),
        ("cross-domain-canonical", ok & ~empty(c("canonical")) & (origin(c("canonical")) != origin(c("site_url"))), "Canonical points to another origin", _json(actual=c("canonical")), None),
        ("canonical-target-error", ok & c("_actual").isNotNull(), "Canonical target is unavailable", F.concat(F.lit('{"target":'), json_string(c("canonical")), F.lit(',"actual":'), c("_actual"), F.lit("}")), json_string(c("canonical"))),
        ("long-redirect-chain", ok & (chain > 3), say("Page uses ", chain, " redirects"), _json(actual=chain, redirectChain=c("redirect_chain")), None),
        ("noindex-in-sitemap", ok & listed & (noindex | x_noindex), "Sitemap URL is marked noindex", _json(actual=F.coalesce("robots", "x_robots")), None),
        ("redirect-in-sitemap", ok & listed & (chain > 0), "Sitemap URL redirects", _json(actual=c("final_url"), redirectChain=c("redirect_chain")), None),
        ("missing-title", ok & ~title, "Page does not have a title", _json(actual=F.lit(None).cast("string")), None),
        ("duplicate-title", ok & title & c("_title_urls").isNotNull(), "Title is shared by multiple pages", _json(actual=c("title"), urls=c("_title_urls")), json_string(c("_title"))),
        ("title-length", ok & title & ((title_n < 10) | (title_n > 60)), say("Title length is ", title_n, " characters"), _json(actual=title_n, value=c("title")), None),
        ("missing-description", ok & ~description, "Page does not have a meta description", _json(actual=F.lit(None).cast("string")), None),
        ("duplicate-description", ok & description & c("_description_urls").isNotNull(), "Meta description is shared by multiple pages", _json(actual=c("description"), urls=c("_description_urls")), json_string(c("_description"))),
        ("description-length", ok & description & ((description_n < 50) | (description_n > 160)), say("Description length is ", description_n, " characters"), _json(actual=description_n, value=c("description")), None),
        ("missing-h1", ok & (c("h1_count") == 0), "Page does not contain an H1 heading", _json(actual=F.lit(0)), None),
        ("multiple-h1", ok & (c("h1_count") > 1), say("Page contains ", c("h1_count"), " H1 headings"), _json(actual=c("h1_count")), None),
        ("orphan-sitemap-page", ok & listed & (c("url") != c("site_url")) & F.coalesce("_orphan", F.lit(False)), "Sitemap page has no discovered internal links", _json(actual=F.lit(True)), None),
        ("crawlable-not-in-sitemap", ok & c("has_sitemap") & ~listed & ~noindex & (F.coalesce("status", F.lit(500)) < 400), "Crawlable page is absent from the sitemap", _json(actual=F.lit(False)), None),
        ("http-on-https-site", ok & F.startswith("site_url", F.lit("https:")) & (F.size(refs) > 0), "HTTPS site references an internal HTTP URL", _json(actual=refs), None),
        ("invalid-language", ok & ~empty(c("lang")) & ~valid_language(c("lang")), "HTML language declaration is invalid", _json(actual=c("lang")), None),
        ("duplicate-content", ok & c("_content_urls").isNotNull(), "Main text is an exact duplicate of another page", _json(urls=c("_content_urls")), json_string(c("_content"))),
        ("missing-open-graph", ok & incomplete("og", ("title", "description", "image")), "Open Graph metadata is incomplete", _json(actual=c("og")), None),
        ("missing-twitter-metadata", ok & incomplete("twitter", ("card", "title", "description", "image")), "Twitter card metadata is incomplete", _json(actual=c("twitter")), None),
        ("image-missing-alt", ok & (F.size(no_alt) > 0), say(F.size(no_alt), " image(s) do not have an alt attribute"), _json(actual=no_alt), None),
        ("low-word-count", ok & (c("word_count") < 200), say("Page contains approximately ", c("word_count"), " visible words"), _json(actual=c("word_count")), None),
    ]
    single = [F.when(when, _found(rule, message, evidence, identity)) for rule, when, message, evidence, identity in one if rule in on]
    none = _found("", "", F.lit(""), None)
    out = [F.array(*single) if single else F.filter(F.array(none), lambda x: F.lit(False))]
    if "invalid-hreflang" in on:
        text = lambda a: F.concat(F.lit("{lang:"), json_string(a["lang"]), F.lit(",url:"), F.coalesce(json_string(a["url"]), F.lit("null")), F.lit("}"))
        wrong = F.filter("hreflang", lambda a: ~valid_language(a["lang"]) | empty(a["url"]))
        out.append(F.when(ok, F.transform(wrong, lambda a: _found("invalid-hreflang", "Hreflang declaration is invalid", _json(actual=a), text(a)))).otherwise(F.array().cast("array<struct<rule:string,message:string,evidence:string,identity:string>>")))
    if "malformed-json-ld" in on:
        blocks = F.filter(F.transform("json_ld", lambda b, i: F.struct(b["valid"].alias("valid"), b["error"].alias("error"), i.alias("index"))), lambda b: ~b["valid"])
        out.append(F.when(ok, F.transform(blocks, lambda b: _found("malformed-json-ld", "JSON-LD block contains invalid JSON", _json(actual=b["error"], index=b["index"]), b["index"].cast("string")))).otherwise(F.array().cast("array<struct<rule:string,message:string,evidence:string,identity:string>>")))
    return out


def with_group_urls(issues: DataFrame, states: dict[str, DataFrame]) -> DataFrame:
    """``issues`` (snapshot_id, rule, url, others) with columns of evidence as an audit with URLs has it; ``states``: for each column the pages whose audit without URLs it is from.

    Lists are made for the groups of the given issues only; other rules' evidence and nulls stay. ``issues`` is read once for each column, and once more.
    """
    key = ["snapshot_id", "rule", "url"]
    keys = F.array(*[F.struct(F.lit(f"duplicate-{n}").alias("rule"), k.alias("_key")) for n, k in _group_keys().items()])
    out = issues
    for name, pages in states.items():
        members = pages.select(*KEY, F.explode(keys).alias("k")).select(*KEY, "k.*").filter("_key is not null")
        asked = issues.filter(F.startswith("rule", F.lit("duplicate-")) & F.col(name).isNotNull()).select(key).distinct().join(members, key)
        groups = members.join(asked.select("snapshot_id", "rule", "_key").distinct(), ["snapshot_id", "rule", "_key"]).groupBy("snapshot_id", "rule", "_key").agg(F.sort_array(F.collect_list("url")).alias("_urls"))
        lists = asked.join(groups, ["snapshot_id", "rule", "_key"]).select(*key, "_urls")
        # The digests are the last field of the evidence.
        whole = F.concat(F.regexp_extract(name, r'(?s)^(.*"urls":)\["[^\]]*\]\}$', 1), F.to_json("_urls"), F.lit("}"))
        out = out.join(lists, key, "left").withColumn(name, F.when(F.col("_urls").isNotNull() & F.col(name).isNotNull(), whole).otherwise(F.col(name))).drop("_urls")
    return out


def audit(pages: DataFrame, sites: DataFrame, sitemap_urls: DataFrame, policy=None, with_urls: bool = True) -> DataFrame:
    """Issues of all snapshots under a policy (see ``policy.Policy``)."""
    from .policy import Policy

    policy = policy or Policy()
    return policy.apply(with_rule_fields(evaluate(pages, sites, sitemap_urls, policy.enabled, with_urls)))
