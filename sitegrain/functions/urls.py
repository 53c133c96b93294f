"""URL functions: native column expressions for common URLs, and a Python form for any."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: extensions of files that are not crawled.
SKIPPED = "avif|bmp|css|csv|docx?|eot|gif|gz|ico|jpe?g|js|json|map|mp3|mp4|mov|ogg|otf|pdf|png|pptx?|rar|rss|svg|tar|tiff?|ttf|txt|wav|webm|webp|woff2?|xlsx?|xml|zip"
_PARTS = r"^(?i)(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"


ENCODED = tuple(' "<>`{}')


def _plain(url: Column) -> Column:
    """Without blanks around and line ends inside, with slashes for backslashes, without user and password."""
    url = F.when(url.rlike(r"^\s|\s$|[\t\n\r\\]"), F.replace(F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), r"[\t\n\r]", ""), F.lit("\\"), F.lit("/"))).otherwise(url)
    return F.when(url.rlike(r"^(?i)https?://[^/?#]*@"), F.regexp_replace(url, r"^((?i)https?://)[^/?#]*@", "$1")).otherwise(url)


def _without_dots(path: Column) -> Column:
    """"." and ".." segments resolved."""
    dot, two = (lambda x: F.lower(x).isin(".", "%2e")), (lambda x: F.lower(x).isin("..", "%2e.", ".%2e", "%2e%2e"))
    step = lambda done, x: F.when(two(x), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(dot(x), done).otherwise(F.concat(done, F.array(x)))
    resolved = F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"(?i)/(\.|%2e)"), F.concat(F.lit("/"), F.array_join(resolved, "/"))).otherwise(path)


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def encode_path(path: Column) -> Column:
    """Non-ASCII characters, blanks and those that a path cannot hold as percent-encoded UTF-8."""
    one = lambda c: F.when((F.octet_length(c) > 1) | c.isin(*ENCODED), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    return F.when(path.rlike(r'[^\x00-\x7F]|[ "<>`{}]'), F.array_join(F.transform(F.split(path, ""), one), "")).otherwise(path)


def encode_query(query: Column) -> Column:
    """The same for a query, which can hold other characters than a path."""
    one = lambda c: F.when((F.octet_length(c) > 1) | c.isin(*' "<>\''), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    return F.when(query.rlike(r"""[^\x00-\x7F]|[ "<>']"""), F.array_join(F.transform(F.split(query, ""), one), "")).otherwise(query)


def origin(url: Column) -> Column:
    """Scheme, host and port (lower case, default ports left out); null for other schemes and malformed URLs."""
    scheme, host = F.lower(_part(url, 1)), F.lower(_part(url, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    return F.when(url.rlike(_PARTS) & ~_part(url, 2).rlike(r"[\s\[\]]"), F.concat(scheme, F.lit("://"), host))


def normalize_url(url: Column, include_query: bool = False) -> Column:
    """Absolute URL without fragment, query (unless asked for) and trailing slashes; null for other schemes. International hosts keep their characters (``normalize`` encodes them)."""
    url = _plain(url)
    path = _without_dots(_part(url, 3))
    path = F.when(path == "", "/").otherwise(F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path))
    path = F.when(path == "", "/").otherwise(path)
    query = encode_query(F.coalesce(_part(url, 4), F.lit(""))) if include_query else F.lit("")
    return F.concat(origin(url), encode_path(path), F.when(query == "?", "").otherwise(query))


def normalize_table(rows: DataFrame, url: str = "url", name: str = "normalized", include_query: bool = False) -> DataFrame:
    """``rows`` with column ``name``: URLs like ``normalize_url`` has them, and hosts as ``normalize`` has them.

    Only hosts that are not plain (international, in brackets, with a port of several spellings or escapes) leave the JVM: each
    of them once, as a dictionary that is joined back. A host that is no host makes the URL null.
    """
    taken = {c.lower() for c in rows.columns}
    clean, host, fixed = (next(x for n in range(len(taken) + 1) if (x := f"_{stem}{n or ''}").lower() not in taken) for stem in ("clean", "host", "fixed"))
    own = rows.withColumn(clean, _plain(F.col(url)))
    found = F.when(F.col(clean).rlike(_PARTS), F.concat(F.lower(_part(F.col(clean), 1)), F.lit("://"), _part(F.col(clean), 2)))
    own = own.withColumn(host, F.when(~found.rlike(r"^https?://[A-Za-z0-9.-]*[A-Za-z][A-Za-z0-9.-]*(:[1-9][0-9]{0,3})?$"), found))

    @F.pandas_udf("string")
    def encoded(hosts: pd.Series) -> pd.Series:
        return hosts.map(lambda h: (normalize(h) or "").removesuffix("/") or None)

    odd = own.filter(F.col(host).isNotNull()).select(host).distinct().withColumn(fixed, encoded(host))
    out = own.join(odd, host, "left")
    # A stand-in host, as only path and query are taken from the column form.
    rest = F.regexp_replace(F.col(clean), r"^(?i)(https?)://[^/?#]+", "$1://h")
    whole = F.concat(F.col(fixed), F.regexp_replace(normalize_url(rest, include_query), "^https?://h", ""))
    return out.withColumn(name, F.when(F.col(host).isNull(), normalize_url(F.col(url), include_query)).otherwise(whole)).select(*rows.columns, name)


def same_origin(url: Column, other: Column) -> Column:
    return F.coalesce(origin(url) == other, F.lit(False))


def is_crawlable(url: Column) -> Column:
    return F.coalesce(origin(url).isNotNull() & ~_part(url, 3).rlike(rf"(?i)\.(?:{SKIPPED})$"), F.lit(False))


def path_and_query(url: Column) -> Column:
    path = _part(url, 3)
    return F.concat(F.when(path == "", "/").otherwise(path), F.coalesce(_part(url, 4), F.lit("")))


def map_origin(url: Column, source: Column, target: Column, prefix: Column | None = None) -> Column:
    """``url`` moved from origin ``source`` to ``target`` (with a path prefix, if given); others stay as they are."""
    rest = F.regexp_replace(url, r"(?i)^https?://[^/?#]+", "")
    start = target if prefix is None else F.concat(target, F.regexp_replace(prefix, "/+$", ""))
    return F.when(origin(url) == source, F.concat(start, rest)).otherwise(url)


def normalize(url: str | None, base: str | None = None, include_query: bool = False) -> str | None:
    """Like ``normalize_url`` in Python, with relative URLs, dot segments and international hosts."""
    if url is None:
        return None
    url = url.strip().replace("\t", "").replace("\n", "").replace("\r", "").replace("\\", "/")
    try:
        parts = urlsplit(urljoin(base, url) if base else url)
        scheme, host, port = parts.scheme.lower(), parts.hostname, parts.port
        if scheme not in ("http", "https") or not host or " " in host:
            return None
        host = host if host.isascii() else host.encode("idna").decode()
    except (ValueError, UnicodeError):
        return None
    path: list[str] = []
    for piece in (parts.path or "/").split("/")[1:]:
        if piece.lower() in ("..", "%2e.", ".%2e", "%2e%2e"):
            path = path[:-1]
        elif piece.lower() not in (".", "%2e"):
            path.append(piece)
    joined = "/" + "/".join(path)
    joined = joined.rstrip("/") or "/"
    host = f"[{host}]" if ":" in host else host
    if port is not None and port != {"http": 80, "https": 443}[scheme]:
        host += f":{port}"
    safe = "%/:@!$&'()*+,;=-._~|^[]\\"
    return urlunsplit((scheme, host, quote(joined, safe=safe), quote(parts.query, safe=safe.replace("'", "") + "?{}`") if include_query else "", ""))


def crawlable(url: str) -> bool:
    """Like ``is_crawlable`` in Python, for normalised URLs."""
    return not re.search(rf"(?i)\.(?:{SKIPPED})$", urlsplit(url).path)
