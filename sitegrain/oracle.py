"""SQL of the audit queries: the same tables and rules, written down independently."""

from __future__ import annotations

from .functions.urls import SKIPPED
from .operators import catalog
from .registry import ROBOTS
from .sources.robots import BODIES as ROBOTS_FILES

assert ROBOTS  # the rules of f10 below are those

def fill(template: str, value: str) -> str:
    return template.replace("{}", value)


Q = "'\"' || replace(replace({}, '\\', '\\\\'), '\"', '\\\"') || '\"'"
ORIGIN = "lower(regexp_extract(url, '^(https?://[^/?#]+)', 1))"
PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
NORMAL_PATH = f"case when regexp_replace({PATH}, '/+$', '') = '' then '/' else regexp_replace({PATH}, '/+$', '') end"
BLANKS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
DECODE = "regexp_replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"
CLEAN = "trim(regexp_replace({}, " + f"'{BLANKS}', ' ', 'g'))"
VISIBLE = fill(CLEAN, fill(DECODE, r"regexp_replace(regexp_replace({}, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"))
ENCODE = "array_to_string(list_transform(string_split({}, ''), lambda c: case when unicode(c) > 127 then regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') else c end), '')"
LINK_PATH = "case when regexp_replace(regexp_replace({}, '[?#].*$', ''), '/+$', '') = '' then '/' else regexp_replace(regexp_replace({}, '[?#].*$', ''), '/+$', '') end"


def base(n: int) -> str:
    """Tables p{n} (pages), s{n} (sites) and m{n} (sitemap URLs) of the state with shift n."""
    links = "list_sort(list_distinct(list_transform(regexp_extract_all(h2, '<a href=\"([^\"]*)\"', 1), lambda x: site || " + fill(ENCODE, fill(LINK_PATH, fill(DECODE, "x"))) + ")))"
    return f"""
n{n} as (select page_id, html, {ORIGIN} as site, {ORIGIN} || {NORMAL_PATH} as url from pages),
g{n} as (select site, url, min(page_id) as page_id, arg_min(html, page_id) as html, min(page_id) + {n} as k from n{n} group by site, url),
u{n} as (select * from g{n}{" union all select site, url || '-gone', page_id, html, k from g1 where page_id % 43 = 0" if n else ""}),
v{n} as (select * replace (case when k % 8 = 7 then '<html lang="en"><head><meta charset="utf-8"><title>Copy</title></head><body><h1>Copy</h1><p>The same text stands on several pages of this site.</p></body></html>' else html end as html) from u{n}),
z{n} as (select * replace (case when k % 4 = 3 then regexp_replace(html, '(?s)<title>.*?</title>', '<title>A title that pages share</title>') when k % 16 = 1 then regexp_replace(html, '(?s)<title>.*?</title>', '<title></title>')
  when k % 16 = 5 then regexp_replace(html, '(?s)<title>.*?</title>', '<title>Short</title>') else html end as html) from v{n}),
y{n} as (select * replace (case when k % 14 = 2 then replace(html, '<h1', '<h2') else html end as html) from z{n}),
w{n} as (select * replace (case when k % 22 = 4 then replace(html, '<html lang="', '<html lang="xx_') else html end as html), substr(lead(url) over (partition by site order by page_id, url), length(site) + 1) as path from y{n}),
i{n} as (select *, replace(html, '<meta charset="utf-8">', '<meta charset="utf-8">'
  || case when k % 9 = 0 then '<h1>Extra</h1>' else '' end
  || case when path is not null and k % 5 <> 1 then '<a href="' || path || '">next</a>' else '' end) as h2 from w{n}),
t{n} as (select *, {fill(VISIBLE, "h2")} as visible, nullif({fill(CLEAN, fill(DECODE, "regexp_extract(h2, '(?s)<title>(.*?)</title>', 1)"))}, '') as title, {links} as links,
  nullif(regexp_extract(h2, '<html lang="([^"]*)"', 1), '') as lang from i{n}),
q{n} as (select *, k % 29 = 0 as blocked, case when k % 29 = 0 then null when k % 31 = 0 then 'redirect loop detected' when k % 37 = 0 then 'timeout' end as error, case when k % 10 = 0 then k % 6 else 0 end as hops from t{n}),
e{n} as (select *, case when not blocked and error is null then case when hops > 0 then site || '/moved' else url end end as final_url from q{n}),
p{n} as (select site, url, k, title, lang, links, blocked, error, hops, not blocked and error is null as ok, final_url,
  case when not blocked and error is null then case when k % 13 = 1 then 404 when k % 17 = 1 then 503 else 200 end end as status,
  case when k % 5 = 0 then null when k % 7 = 0 then 'A description that several pages of this site have in common.' when k % 26 = 11 then 'Too short.' else 'Page ' || k || ' of this site has a description of its own, long enough to be useful.' end as description,
  case when k % 6 = 0 then null when k % 23 = 0 then 'http://[bad' when k % 19 = 0 then 'https://elsewhere.example.org/c' when k % 34 = 9 then regexp_replace(site, '^https?', 'http') || '/c' else '?' end as canonical_raw,
  case when k % 6 = 0 or k % 23 = 0 then null when k % 19 = 0 then 'https://elsewhere.example.org/c' when k % 34 = 9 then regexp_replace(site, '^https?', 'http') || '/c' else coalesce(final_url, url) end as canonical,
  case when k % 11 = 0 then 'noindex, follow' end as robots, case when k % 41 = 0 then 'noindex' end as x_robots,
  length(h2) - length(replace(h2, '<h1', '<h')) as h1, case when visible = '' then 0 else len(string_split(visible, ' ')) end as words, case when visible <> '' then sha256(lower(visible)) end as hash,
  k % 3 <> 0 as listed, visible from e{n}),
m{n} as (select site, url from p{n} where listed),
s{n} as (select site, site || '/' as site_url, min(page_id) as least, count(*) filter (k % 3 <> 0) as sitemap_count, min(page_id) % 5 <> 0 as complete, sha256('robots ' || case when min(page_id) % 2 = 0 then {n} else 0 end) as robots_sha from u{n} group by site),
o{n} as (select m.site, m.url from m{n} m where not exists (select 1 from p{n} x, unnest(x.links) as l(t) where x.site = m.site and l.t = m.url)),
b{n} as (select site, url, coalesce(cast(status as varchar), error) as actual from p{n} where error is not null or coalesce(status, 500) >= 400)"""


LANG_OK = r"regexp_matches(lower(lang), '^(?:[a-z]{2,3}|[a-z]{5,8})(?:-[a-z]{4})?(?:-(?:[a-z]{2}|[0-9]{3}))?$')"


#: Messages of the rules, over the columns of a page.
MESSAGES = {
    "robots-blocked": "'Page is blocked by robots.txt'", "redirect-loop": "'Page request failed: ' || error", "page-unreachable": "'Page request failed: ' || error", "http-error": "'Page returned HTTP ' || status",
    "noindex": "'Page contains a noindex meta directive'", "x-robots-noindex": "'Page contains a noindex X-Robots-Tag'", "missing-canonical": "'Page does not declare a canonical URL'",
    "invalid-canonical": "'Canonical URL is invalid'", "cross-domain-canonical": "'Canonical points to another origin'", "long-redirect-chain": "'Page uses ' || hops || ' redirects'",
    "noindex-in-sitemap": "'Sitemap URL is marked noindex'", "redirect-in-sitemap": "'Sitemap URL redirects'", "missing-title": "'Page does not have a title'", "title-length": "'Title length is ' || length(title) || ' characters'",
    "missing-description": "'Page does not have a meta description'", "description-length": "'Description length is ' || length(description) || ' characters'", "missing-h1": "'Page does not contain an H1 heading'",
    "multiple-h1": "'Page contains ' || h1 || ' H1 headings'", "crawlable-not-in-sitemap": "'Crawlable page is absent from the sitemap'", "http-on-https-site": "'HTTPS site references an internal HTTP URL'",
    "invalid-language": "'HTML language declaration is invalid'", "missing-open-graph": "'Open Graph metadata is incomplete'", "missing-twitter-metadata": "'Twitter card metadata is incomplete'",
    "image-missing-alt": "'1 image(s) do not have an alt attribute'", "low-word-count": "'Page contains approximately ' || words || ' visible words'", "canonical-target-error": "'Canonical target is unavailable'",
    "broken-internal-link": "'Internal link points to an unavailable page'", "orphan-sitemap-page": "'Sitemap page has no discovered internal links'", "invalid-hreflang": "'Hreflang declaration is invalid'",
    "malformed-json-ld": "'JSON-LD block contains invalid JSON'", "sitemap-unavailable": "'The configured sitemap could not be loaded'", "duplicate-title": "'Title is shared by multiple pages'",
    "duplicate-description": "'Meta description is shared by multiple pages'", "duplicate-content": "'Main text is an exact duplicate of another page'",
}


def rules(n: int) -> dict[str, str]:
    """For each rule, a query of (site, url, identity, evidence: equal where the findings' evidence is, message)."""
    p, simple = f"p{n}", {}
    noindex = "(robots is not null or x_robots is not null)"
    for rule, when, evidence in [
        ("robots-blocked", "blocked", "''"), ("redirect-loop", "not blocked and error like '%redirect loop%'", "error || hops"), ("page-unreachable", "not blocked and error not like '%redirect loop%'", "error || hops"),
        ("http-error", "ok and status >= 400", "cast(status as varchar)"), ("noindex", "ok and robots is not null", "robots"), ("x-robots-noindex", "ok and x_robots is not null", "x_robots"),
        ("missing-canonical", "ok and canonical_raw is null", "''"), ("invalid-canonical", "ok and canonical_raw is not null and canonical is null", "canonical_raw"),
        ("cross-domain-canonical", "ok and not starts_with(canonical, site || '/')", "canonical"), ("long-redirect-chain", "ok and hops > 3", "cast(hops as varchar)"),
        ("noindex-in-sitemap", f"ok and listed and {noindex}", "coalesce(robots, x_robots)"), ("redirect-in-sitemap", "ok and listed and hops > 0", "cast(hops as varchar)"),
        ("missing-title", "ok and title is null", "''"), ("title-length", "ok and (length(title) < 10 or length(title) > 60)", "title"), ("missing-description", "ok and description is null", "''"),
        ("description-length", "ok and (length(description) < 50 or length(description) > 160)", "description"), ("missing-h1", "ok and h1 = 0", "''"), ("multiple-h1", "ok and h1 > 1", "cast(h1 as varchar)"),
        ("crawlable-not-in-sitemap", "ok and not listed and robots is null and status < 400", "''"),
        ("http-on-https-site", "ok and site like 'https:%' and (canonical like 'http:%')", "canonical"), ("invalid-language", f"ok and lang is not null and not {LANG_OK}", "lang"),
        ("missing-open-graph", "ok and k % 3 <> 0", "''"), ("missing-twitter-metadata", "ok and k % 8 <> 0", "''"), ("image-missing-alt", "ok and k % 4 = 0", "''"), ("low-word-count", "ok and words < 200", "cast(words as varchar)"),
    ]:
        simple[rule] = f"select site, url, 'null' as identity, {evidence} as evidence, {MESSAGES[rule]} as message from {p} where {when}"
    simple["canonical-target-error"] = f"select p.site, p.url, {fill(Q, 'p.canonical')} as identity, b.actual as evidence, {MESSAGES["canonical-target-error"]} as message from {p} p join b{n} b on b.site = p.site and b.url = p.canonical where ok"
    simple["broken-internal-link"] = f"select p.site, p.url, {fill(Q, 'b.url')} as identity, b.actual as evidence, {MESSAGES["broken-internal-link"]} as message from (select site, url, unnest(links) as t from {p} where ok) p join b{n} b on b.site = p.site and b.url = p.t"
    simple["orphan-sitemap-page"] = f"select p.site, p.url, 'null' as identity, '' as evidence, {MESSAGES['orphan-sitemap-page']} as message from {p} p join o{n} using (site, url) where ok and p.url <> p.site || '/'"
    simple["invalid-hreflang"] = "select site, url, '{lang:\"en_bad\",url:\"' || site || '/alternate\"}' as identity, '' as evidence, " + MESSAGES["invalid-hreflang"] + " as message from " + p + " where ok and k % 13 = 0"
    simple["malformed-json-ld"] = f"select site, url, '0' as identity, '' as evidence, {MESSAGES['malformed-json-ld']} as message from {p} where ok and k % 17 = 0"
    simple["sitemap-unavailable"] = f"select site, site || '/sitemap.xml' as url, 'null' as identity, '' as evidence, {MESSAGES['sitemap-unavailable']} as message from s{n} where least % 7 = 0"
    for rule, key, actual in [("duplicate-title", "lower(trim(title))", "title"), ("duplicate-description", "lower(trim(description))", "description"), ("duplicate-content", "hash", "''")]:
        simple[rule] = f"select site, url, {fill(Q, 'key')} as identity, {actual} || urls as evidence, {MESSAGES[rule]} as message from (select *, {key} as key from {p}) join (select site, {key} as key, cast(list_sort(list(url)) as varchar) as urls from {p} where {key} is not null group by all having count(*) > 1) using (site, key) where ok"
    return simple


def evidence() -> dict[str, str]:
    """For each rule, the evidence as JSON text, over what ``rules`` selects from (``b`` is a page that is unavailable)."""
    chain = "list_transform(range(cast(hops as bigint)), lambda i: {'url': url, 'status': 301, 'location': site || '/moved'})"
    none = "cast(null as varchar)"
    fields = {
        "robots-blocked": {"actual": "true"}, "redirect-loop": {"actual": "error", "redirectChain": chain}, "page-unreachable": {"actual": "error", "redirectChain": chain}, "http-error": {"actual": "status"},
        "noindex": {"actual": "robots"}, "x-robots-noindex": {"actual": "x_robots"}, "missing-canonical": {"actual": none}, "invalid-canonical": {"actual": "canonical_raw"}, "cross-domain-canonical": {"actual": "canonical"},
        "long-redirect-chain": {"actual": "hops", "redirectChain": chain}, "noindex-in-sitemap": {"actual": "coalesce(robots, x_robots)"}, "redirect-in-sitemap": {"actual": "final_url", "redirectChain": chain},
        "missing-title": {"actual": none}, "title-length": {"actual": "length(title)", "value": "title"}, "missing-description": {"actual": none}, "description-length": {"actual": "length(description)", "value": "description"},
        "missing-h1": {"actual": "0"}, "multiple-h1": {"actual": "h1"}, "crawlable-not-in-sitemap": {"actual": "false"}, "http-on-https-site": {"actual": "[canonical]"}, "invalid-language": {"actual": "lang"},
        "missing-open-graph": {"actual": f"{{'title': 't', 'description': 'd', 'image': {none}}}"}, "missing-twitter-metadata": {"actual": f"{{'card': 'summary', 'title': 't', 'description': 'd', 'image': {none}}}"},
        "image-missing-alt": {"actual": "['/a.png']"}, "low-word-count": {"actual": "words"}, "orphan-sitemap-page": {"actual": "true"}, "invalid-hreflang": {"actual": "{'lang': 'en_bad', 'url': site || '/alternate'}"},
        "malformed-json-ld": {"actual": "'Expecting value: line 1 column 6 (char 5)'", "index": "0"}, "sitemap-unavailable": {"actual": "'HTTP 503'"},
        "duplicate-title": {"actual": "title", "urls": "urls"}, "duplicate-description": {"actual": "description", "urls": "urls"}, "duplicate-content": {"urls": "urls"},
    }
    out = {rule: "to_json({" + ", ".join(f"'{k}': {v}" for k, v in f.items()) + "})::varchar" for rule, f in fields.items()}
    actual = "case when regexp_matches(b.actual, '^[0-9]+$') then b.actual else coalesce(to_json(b.actual)::varchar, 'null') end"
    return out | {rule: f"""'{{"target":' || to_json({target})::varchar || ',"actual":' || {actual} || '}}'""" for rule, target in (("canonical-target-error", "p.canonical"), ("broken-internal-link", "b.url"))}


def told(n: int) -> dict[str, str]:
    """``rules`` with the evidence as JSON text."""
    out = {}
    for rule, query in rules(n).items():
        head, rest = query.split(" as identity, ", 1)
        rest = rest.split(f" as evidence, {MESSAGES[rule]} as message from ", 1)[1]
        out[rule] = f"{head} as identity, {evidence()[rule]} as evidence, {MESSAGES[rule]} as message from {rest.replace('cast(list_sort(list(url)) as varchar) as urls', 'list_sort(list(url)) as urls')}"
    return out


def changes() -> dict[str, str]:
    """For each regression rule (p1 before, p0 after), a query of (site, url, own severity or null, message, before, after)."""
    pairs = "(select b.*, a as a from p1 b left join p0 a using (site, url)) join s0 using (site)"
    blocked = "a.url is not null and a.blocked and not blocked"
    fails = f"a.url is not null and not ({blocked}) and a.error is not null and error is null"
    go = f"a.url is not null and not ({blocked}) and not ({fails})"
    flags = "(robots is not null or x_robots is not null)"
    out = {}
    flagged = lambda t: f"coalesce({t}robots, '') || ',' || coalesce({t}x_robots, '')"
    for rule, when, severity, message, before, after in [
        ("page-missing", "a.url is null and complete", "null", "'Page was not checked'", "status", "null"), ("robots-blocked", blocked, "null", "'Page is now blocked by robots.txt'", "'false'", "'true'"),
        ("redirect-loop", f"{fails} and a.error like '%redirect loop%'", "null", "'Page request failed: ' || a.error", "error", "a.error"),
        ("page-unreachable", f"{fails} and a.error not like '%redirect loop%'", "null", "'Page request failed: ' || a.error", "error", "a.error"),
        ("status-regression", f"{go} and status < 400 and coalesce(a.status, 500) >= 400", "null", "'HTTP status regressed from ' || status || ' to ' || coalesce(cast(a.status as varchar), 'none')", "status", "a.status"),
        ("new-noindex", f"{go} and not {flags} and (a.robots is not null or a.x_robots is not null)", "null", "'Page now contains a noindex directive'", flagged(""), flagged("a.")),
        ("title-removed", f"{go} and title is not null and a.title is null", "null", "'Page title was removed'", "title", "a.title"), ("title-changed", f"{go} and title <> a.title", "null", "'Page title changed'", "title", "a.title"),
        ("description-removed", f"{go} and description is not null and a.description is null", "null", "'Meta description was removed'", "description", "a.description"),
        ("canonical-removed", f"{go} and canonical is not null and a.canonical is null", "null", "'Canonical URL was removed'", "canonical", "a.canonical"),
        ("canonical-changed", f"{go} and canonical <> a.canonical", "case when not starts_with(a.canonical, site || '/') then 'error' end", "'Canonical URL changed'", "canonical", "a.canonical"),
        ("h1-removed", f"{go} and h1 > 0 and a.h1 = 0", "null", "'All H1 headings were removed'", "h1", "a.h1"), ("redirect-changed", f"{go} and final_url <> a.final_url", "null", "'Final redirect URL changed'", "final_url", "a.final_url"),
    ]:
        out[rule] = f"select site, url, cast({severity} as varchar) as own, {message} as message, cast({before} as varchar) as before, cast({after} as varchar) as after from (select * from {pairs}) where {when}"
    none = "cast(null as varchar) as own"
    out["robots-changed"] = f"select site, site || '/robots.txt' as url, {none}, 'robots.txt content changed' as message, s1.robots_sha as before, s0.robots_sha as after from s1 join s0 using (site) where s1.robots_sha <> s0.robots_sha"
    out["sitemap-url-count-drop"] = f"select site, site || '/sitemap.xml' as url, {none}, 'Sitemap URL count dropped by ' || (b - a) as message, cast(b as varchar) as before, cast(a as varchar) as after from (select b.site, b.sitemap_count as b, a.sitemap_count as a, a.complete from s1 b join s0 a using (site)) where complete and b > 0 and b - a >= greatest(5, ceil(b * 0.2::double))"
    return out


VALUES = "catalog(rule, severity, scope, owner) as (values " + ", ".join(f"('{r}', '{s}', '{scope}', '{owner}')" for r, s, owner, scope, _ in catalog.RULES) + ")"
PRINT = "substr(sha256(rule || chr(10) || scope || chr(10) || url || chr(10) || {}), 1, 24)"


def _issues(n: int, only: str | None = None, made=rules) -> str:
    parts = [f"select '{r}' as rule, * from ({q})" for r, q in made(n).items() if only in (None, r)]
    return f"a{n} as (select site as snapshot_id, rule, severity, scope, owner, url, {PRINT.format('identity')} as fingerprint, evidence, message from ({' union all '.join(parts)}) join catalog using (rule))"


def _changed(only: str | None = None) -> str:
    parts = [f"select '{r}' as rule, * from ({q})" for r, q in changes().items() if only in (None, r)]
    return f"""c as (select site as snapshot_id, rule, coalesce(own, severity) as severity, scope, owner, url, {PRINT.format("'null'")} as fingerprint, message, before, after from ({' union all '.join(parts)}) join catalog using (rule))"""


COLUMNS = "snapshot_id, rule, severity, scope, owner, url, fingerprint, message"
DIFF = """
x1 as (select snapshot_id, fingerprint, max(rule) as rule, max(severity) as severity, max(scope) as scope, max(url) as url, max(message) as message, max(evidence) as evidence from a1 group by all),
x0 as (select snapshot_id, fingerprint, max(rule) as rule, max(severity) as severity, max(scope) as scope, max(url) as url, max(message) as message, max(evidence) as evidence from a0 group by all),
f as (select coalesce(a.snapshot_id, b.snapshot_id) as snapshot_id, coalesce(a.rule, b.rule) as rule, coalesce(a.severity, b.severity) as severity, coalesce(a.scope, b.scope) as scope, coalesce(a.url, b.url) as url, coalesce(a.fingerprint, b.fingerprint) as fingerprint, coalesce(a.message, b.message) as message, cast(null as varchar) as before, cast(null as varchar) as after,
  case when b.fingerprint is null then 'new' when a.fingerprint is not null then case when a.evidence = b.evidence then 'unchanged' else 'ongoing' end
    when case when b.scope = 'page' then exists (select 1 from p0 where p0.site = b.snapshot_id and p0.url = b.url) else coalesce((select complete from s0 where s0.site = b.snapshot_id), false) end then 'resolved' end as lifecycle
  from x0 a full join x1 b on a.snapshot_id = b.snapshot_id and a.fingerprint = b.fingerprint),
d as (select * from f where lifecycle is not null union all
  select snapshot_id, rule, severity, scope, url, fingerprint, message, before, after, 'new' from c where not exists (select 1 from f where f.lifecycle = 'new' and f.snapshot_id = c.snapshot_id and f.fingerprint = c.fingerprint))"""

#: The same, with what each finding says: evidence then and now of ongoing ones, what is there now of others.
ONGOING = "a.fingerprint is not null and b.fingerprint is not null and a.evidence <> b.evidence"
DIFF_TOLD = DIFF.replace(
    "cast(null as varchar) as before, cast(null as varchar) as after",
    f"case when {ONGOING} then b.evidence end as before, case when {ONGOING} then a.evidence else json_extract_string(coalesce(a.evidence, b.evidence), '$.actual') end as after",
)


def sql() -> dict:
    one = f"with {VALUES}, {base(0)}"
    two = f"{one}, {base(1)}"
    whole = f"{two}, {_issues(0)}, {_issues(1)}, {_changed()}, {DIFF}"
    words = f"nullif({fill(CLEAN, 'text')}, '')"
    out = {f"r{i:02d}_{r.replace('-', '_')}": f"{one}, {_issues(0, r)} select {COLUMNS} from a0" for i, r in enumerate(catalog.CURRENT, 1)}
    out |= {f"r{i:02d}_{r.replace('-', '_')}": f"{two}, {_changed(r)} select {COLUMNS}, before, after from c" for i, r in enumerate(catalog.REGRESSION, 35)}
    out |= {
        "c1_audit": f"{one}, {_issues(0)} select {COLUMNS} from a0",
        "c2_regressions": f"{two}, {_changed()} select {COLUMNS}, before, after from c",
        "c3_diff_lifecycle": f"{two}, {_issues(0, made=told)}, {_issues(1, made=told)}, {_changed()}, {DIFF_TOLD} select *, lifecycle = 'ongoing' as has_both from d",
        "s21_lifecycle_summary": f"{whole} select snapshot_id, count(*) filter (lifecycle = 'new') as \"new\", count(*) filter (lifecycle = 'ongoing') as ongoing, count(*) filter (lifecycle = 'unchanged') as unchanged, count(*) filter (lifecycle = 'resolved') as resolved, count(*) filter (lifecycle in ('new', 'ongoing')) as current from d group by snapshot_id",
        "a8_rule_list": f"{one}, {_issues(0)} select distinct rule, upper(substr(rule, 1, 1)) || replace(substr(rule, 2), '-', ' ') as label from a0",
        "c4_policy": f"{one}, {_issues(0)} select snapshot_id, rule, case when rule = 'noindex' then 'error' else severity end as severity, scope, owner, url, fingerprint, message from a0 where rule = 'noindex' or (rule = 'missing-canonical' and not regexp_matches(url, '^https?://[^/]+/en/'))",
        "c14_gate": f"{one}, {_issues(0)} select snapshot_id, bool_or(severity = 'error') as blocked from a0 group by 1",
        "a2_statistics": f"{one} select site as snapshot_id, count(*) as completed, count(*) - count(*) filter (error is not null or coalesce(status, 500) >= 400) - count(*) filter (blocked) as succeeded, count(*) filter (error is not null or coalesce(status, 500) >= 400) as failed, count(*) filter (blocked) as blocked_by_robots, count(*) filter (hops > 0 or url is distinct from final_url) as redirected from p0 group by site",
        "a3_link_graph": f"{one} select p0.site as snapshot_id, cast(sum(len(links)) as bigint) as internal_edges, cast(0 as bigint) as external_edges, count(*) filter (blocked or error is not null or coalesce(status, 500) >= 400) as broken_pages, (select count(*) from o0 where o0.site = p0.site) as orphan_pages from p0 group by p0.site",
        "a4_health": f"{one} select site as snapshot_id, count(*) filter (blocked or error is not null or coalesce(status, 500) >= 400) as unavailable, count(*) filter (title is null) as missing_title, count(*) filter (description is null) as missing_description, count(*) filter (canonical is null) as missing_canonical, count(*) filter (h1 = 0) as missing_h1, count(*) filter (robots is not null) as noindex from p0 group by site",
        "a5_severity_summary": f"{one}, {_issues(0)} select severity, count(*) as n, count(distinct url) as pages from a0 group by severity",
        "a7_budgets": f"{whole} select snapshot_id, budget, cast(allowed as bigint) as allowed, count(*) as actual from d, (values ('error', 1), ('title-changed', 0), ('noindex', 1000)) as g(budget, allowed) where lifecycle = 'new' and (severity = budget or rule = budget) group by snapshot_id, budget, allowed having count(*) > allowed",
        "c14_gate_budgets": f"{whole}, x as (select snapshot_id, budget, count(*) as n, max(allowed) as allowed from d, (values ('warning', 3), ('title-changed', 0)) as g(budget, allowed) where lifecycle = 'new' and (severity = budget or rule = budget) group by all having count(*) > max(allowed)) select snapshot_id, blocked, over, blocked or over > 0 as failed from (select snapshot_id, bool_or(lifecycle = 'new' and severity = 'error') as blocked, (select count(*) from x where x.snapshot_id = d.snapshot_id) as over from d group by snapshot_id)",
        "j5_orphans": f"{one} select site as snapshot_id, url from o0",
        "f1_normalize_url": f"select page_id, {ORIGIN} || {NORMAL_PATH} as url, {ORIGIN} || {NORMAL_PATH} || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) as with_query from pages",
        "f2_origin": f"select page_id, {ORIGIN} as origin, {ORIGIN} = 'https://www.thering.example.org' as same from pages",
        "f3_crawlable": "select page_id, not regexp_matches(regexp_extract(url || ['', '.pdf', '.PNG', '.html'][page_id % 4 + 1], '^[^?#]*'), '(?i)\\.(pdf|png)$') as crawlable from pages",
        "f4_map_origin": f"select page_id, case when page_id % 2 = 0 then 'https://preview.example.org' else {ORIGIN} end || {NORMAL_PATH} as url from pages",
        "f5_map_prefix": f"select page_id, 'https://preview.example.org/sub' || {NORMAL_PATH} as url from pages",
        "f6_clean_text": f"select doc_id, {words} as cleaned from documents",
        "f7_has_directive": "select page_id, page_id % 5 in (0, 2, 3) as noindex from pages",
        "f8_valid_language": "select page_id, page_id % 8 not in (3, 5) as valid from pages",
        "f10_robots_allowed": f"select page_id, case when {PATH} like '%.html' and strpos(url, '?') = 0 then false when starts_with({PATH}, '/en/1') then true when starts_with({PATH}, '/en/') then false else true end as allowed from pages",
        "f12_content_hash": f"select doc_id, sha256(lower({words})) as content_hash from documents",
        "f13_word_count": f"select doc_id, cast(coalesce(len(string_split({words}, ' ')), 0) as bigint) as n_words from documents",
        "f15_fingerprint": "select page_id, substr(sha256('missing-title' || chr(10) || 'page' || chr(10) || url || chr(10) || 'null'), 1, 24) as fingerprint from pages",
        "s12_sitemap_parse": f"select distinct {ORIGIN} as site, {ORIGIN} || {NORMAL_PATH} as url from pages",
        "a1_duplicate_content": f"select sha256(lower({words})) as content_hash, count(*) as n, min(doc_id) as first_doc from documents where {words} is not null group by 1 having count(*) > 1",
        "s15_checkpoint_last": f"with l as (select {ORIGIN} || {NORMAL_PATH} as url, page_id, row_number() over (partition by {ORIGIN} || {NORMAL_PATH} order by page_id desc) as nth from pages) select url, cast(case when page_id % 13 = 1 then 404 else 200 end as bigint) as status, page_id as seq from l where nth = 1 and page_id % 17 <> 1 and page_id % 37 <> 0",
        "st_replay": "select event_id, user_id, event_type, round(value, 2) as value from events where event_type is not null",
    }
    links = "list_distinct(list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda x: " + fill(ENCODE, fill(LINK_PATH, fill(DECODE, "x"))) + "))"
    out["h_extract"] = f"""with v as (select *, {fill(VISIBLE, "html")} as visible from pages)
        select page_id, nullif({fill(CLEAN, fill(DECODE, "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))}, '') as title, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') as lang,
        length(html) - length(replace(html, '<h1', '<h')) as h1_count, cast(case when visible = '' then 0 else len(string_split(visible, ' ')) end as bigint) as n_words,
        case when visible <> '' then sha256(lower(visible)) end as content_hash, cast(len({links}) as bigint) as n_links, cast(0 as bigint) as n_external from v"""
    # Every page is a seed here and other URLs are 404, so the scan has two levels.
    held = "ruled and substr({u}, length(site) + 1) like '/en/%' and substr({u}, length(site) + 1) not like '/en/1%'"
    out["c11_scan"] = f"""with n as (select page_id, html, {ORIGIN} as site, {ORIGIN} || {NORMAL_PATH} as url from pages),
        g as (select site, url, arg_min(html, page_id) as html from n group by site, url), f as (select site, min(page_id) % 2 = 0 as ruled from n group by site),
        o as (select *, {held.format(u="url")} as blocked from g join f using (site)),
        l as (select distinct site, ruled, site || unnest({links}) as url from o where not blocked)
        select site as snapshot_id, url, cast(0 as bigint) as depth, cast(case when not blocked then 200 end as bigint) as status, blocked, cast(case when blocked then 0 else length(html) - length(replace(html, '<h1', '<h')) end as bigint) as h1_count from o
        union all select site, url, 1, case when not ({held.format(u="url")}) then 404 end, {held.format(u="url")}, 0 from l where not exists (select 1 from g where g.site = l.site and g.url = l.url)
        and not regexp_matches(url, '(?i)\\.(?:{SKIPPED})$')"""
    out["st5_lifecycle"] = f"{whole} select *, lifecycle = 'ongoing' as has_both from d"
    out["st4_group_rules"] = f"{one}, {_issues(0)} select rule, snapshot_id, url from a0 where rule in ('duplicate-title', 'orphan-sitemap-page')"
    out["st1_page_table"] = f"""with l as (select {ORIGIN} || {NORMAL_PATH} as url, page_id + w as k, page_id + w * 10000000 as seq from pages, range(3) as r(w) where page_id % (w + 1) = 0)
        select url, cast(case when k % 17 = 1 then 503 when k % 13 = 1 then 404 else 200 end as bigint) as status, case when k % 37 = 0 then 'timeout' end as error, seq from l qualify row_number() over (partition by url order by seq desc) = 1"""
    audit = out["c1_audit"]
    glob = r"'^' || replace(replace(replace(regexp_replace(pattern, '([\\.\[\]{}()+^$|?])', '\\\1', 'g'), '**', chr(1)), '*', '[^/]*'), chr(1), '.*') || '$'"
    out["j15_suppressions"] = f"""with w as ({audit}), u as (select page_id as k, {PATH} as path, regexp_extract(url, '^([^?#]*)', 1) as whole from pages),
        s as (select 'missing-open-graph' as rule, path || '**' as pattern, null as until from u union all select 'missing-twitter-metadata', whole || '*', make_date(2026 + k % 3, 6, 30) from u
          union all select 'low-word-count', regexp_replace(path, '[0-9]', '*', 'g'), make_date(2026 + k % 2, 12, 31) from u union all select 'missing-canonical', '**' || right(path, 2), null from u),
        g as (select distinct rule, {glob} as regex from s where until is null or until >= date '2027-01-01')
        select * from w where not exists (select 1 from g where g.rule = w.rule and (regexp_matches(w.url, regex) or regexp_matches(case when regexp_extract(w.url, '^https?://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(w.url, '^https?://[^/?#]+([^?#]*)', 1) end, regex)))"""
    out["o1_issue_rank"] = f"""select snapshot_id, fingerprint, rule, url, rank, cast(ceil(rank / 100) as bigint) as page from (select *, row_number() over (order by case severity when 'error' then 0 when 'warning' then 1 else 2 end, url, rule, fingerprint, snapshot_id) as rank from ({audit}))"""
    bodies = ", ".join("'" + b.replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'" for b in ROBOTS_FILES)
    regex = r"'^' || replace(regexp_replace(regexp_replace(pattern, '\$$', ''), '([\\.\[\]{}()+^$|?])', '\\\1', 'g'), '*', '.*') || case when pattern like '%$' then '$' else '' end"
    full = "case when regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) end || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"
    out["j16_robots_tables"] = f"""with p as (select page_id, {ORIGIN} as site, url, {full} as path from pages),
        f as (select site, [{bodies}][arg_min(page_id % 4, page_id) + 1] || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: ' || arg_min(path, page_id) || chr(10) as body from p group by site),
        l as (select site, generate_subscripts(string_split_regex(body, '\\r?\\n'), 1) as nr, split_part(unnest(string_split_regex(body, '\\r?\\n')), '#', 1) as line from f),
        v as (select site, nr, lower(trim(split_part(line, ':', 1))) as key, trim(substr(line, strpos(line, ':') + 1)) as value from l where strpos(line, ':') > 0),
        r as (select * from v where key = 'user-agent' or (key in ('allow', 'disallow') and value <> '')),
        b as (select *, key = 'user-agent' and coalesce(lag(key) over (partition by site order by nr) <> 'user-agent', false) as begins from r),
        n as (select *, sum(begins::int) over (partition by site order by nr) as part, key = 'user-agent' and value not in ('', '*') and contains('auditor/1.0', lower(value)) as mine from b),
        h as (select *, bool_or(mine) over (partition by site, part) as named, bool_or(key = 'user-agent' and value = '*') over (partition by site, part) as everyone, bool_or(mine) over (partition by site) as special from n),
        t as (select distinct site, key as kind, value as pattern from h where key <> 'user-agent' and case when special then named else everyone and not named end),
        x as (select *, {regex} as regex from t)
        select p.site, p.url, coalesce(max(case when kind = 'allow' then length(pattern) end), -1) >= coalesce(max(case when kind = 'disallow' then length(pattern) end), -1) as allowed
        from (select distinct site, url, path from p) p left join x on x.site = p.site and regexp_matches(p.path, x.regex) group by p.site, p.url"""
    out["l2_crawl"] = f"""with recursive {one.removeprefix("with ")},
        edges as (select distinct site, url, unnest(links) as target from p0),
        seeds as (select distinct site, url from (select site, arg_min(url, page_id) as url from g0 group by site union all select site, url from m0 where not regexp_matches(url, '(?i)\\.(?:{SKIPPED})$'))),
        reached(site, url, depth) using key (site, url) as (select site, url, 0 from seeds union select e.site, e.target, min(r.depth) + 1 from reached r join edges e on e.site = r.site and e.url = r.url
          where not regexp_matches(e.target, '(?i)\\.(?:{SKIPPED})$') and not exists (select 1 from recurring.reached d where d.site = e.site and d.url = e.target) group by e.site, e.target)
        select site, url, cast(depth as bigint) as depth from reached"""
    out["s10_sitemap_index"] = f"""with recursive n as (select page_id % 512 as part, {ORIGIN} || {NORMAL_PATH} as url from pages),
        p as (select distinct site, part, site || '/' || regexp_extract(url, '^https?://(.*)$', 1) as url from (select *, 'https://' || regexp_extract(url, '([^./]+\\.[^./:]+)(?::[0-9]+)?(/|$)', 1) as site from n)),
        m as (select distinct site, part, site || '/maps/' || part % 24 as stem from p), f as (select *, stem || '.xml' as middle, stem || '-' || part || case when part % 2 = 0 then '.xml.gz' else '.xml' end as leaf from m),
        k as (select site || '/sitemap.xml' as file, list(distinct middle) as kids from f group by site union all select middle, list(distinct leaf) from f group by middle),
        q as (select distinct site, 0 as step, cast(null as varchar) as file, [site || '/sitemap.xml'] as queue from p
          union all select q.site, q.step + 1, q.queue[1], list_sort(list_concat(q.queue[2:], coalesce(k.kids, []))) from q left join k on k.file = q.queue[1] where len(q.queue) > 0 and q.step < 100),
        u as (select p.site, p.url, min(q.step) as step from p join f using (site, part) join q on q.site = p.site and q.file = f.leaf group by all),
        r as (select *, row_number() over (partition by site order by step, url) as nth from u),
        b as (select q.site, q.step, (select count(*) from u where u.site = q.site and u.step < q.step) as before, exists (select 1 from f where f.leaf = q.file and part % 7 = 3 and f.site like '%.net') as broken from q where q.step > 0),
        s as (select site, count(*) as files, bool_or(broken) as bad, min(case when broken then step end) as at from b where before < 50000 group by site),
        t as (select site, files, bad, (select count(*) from r where r.site = s.site and nth <= 50000) as n, (select q.file from q where q.site = s.site and q.step = s.at) as wrong from s)
        select t.site, r.url, case when bad then 0 else files end as files, case when bad then 0 else n end as n_urls, not bad and (files >= 100 or n >= 50000) as truncated,
        case when not bad then null when wrong like '%.gz' or wrong like '%.xml' then 'invalid sitemap at ' || wrong || ': ParseError' end as error from t left join r on r.site = t.site and not t.bad and r.nth <= 50000"""
    out["f17_html_escape"] = """select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') as escaped from documents"""
    out["f22_report_filter"] = f"select * from ({audit}) where severity = 'error' and owner = 'developer' and contains(lower(concat_ws(' ', url, rule, message, owner)), 'example.org/en')"
    out["s21_summary"] = f"""select snapshot_id, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'info') as infos,
        count(distinct url) as affected, bool_or(severity = 'error') as blocked from ({audit}) group by snapshot_id"""
    out["s20_csv_lines"] = f"""select concat('"', severity, '","current","', rule, '","', owner, '","', replace(url, '"', '""'), '","', replace(message, '"', '""'), '","","","Review the finding and confirm the intended behavior.","', fingerprint, '"') as value from ({audit})"""
    return out
