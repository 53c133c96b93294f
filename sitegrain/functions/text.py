"""Text functions as native column expressions."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, functions as F

#: Fixed value: white space of HTML text, with Unicode blanks (Java regular expression class).
WS = "[ \\t\\n\\x0B\\f\\r\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: Fixed value: language tags.
LANGUAGE = (
    r"(?i)^(?:[a-z]{2,3}|[a-z]{5,8})(?:-[a-z]{4})?(?:-(?:[a-z]{2}|[0-9]{3}))?(?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*"
    r"(?:-[0-9a-wy-z](?:-[a-z0-9]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?$"
)


def clean_text(x: Column) -> Column:
    """White space collapsed and trimmed; null for nothing left. Single blanks, most of all white space, are not replaced by themselves."""
    return F.nullif(F.trim(F.regexp_replace(x, f"{WS}{{2,}}|{WS.replace(' ', '', 1)}", " ")), F.lit(""))


def empty(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) == ""


def has_directive(value: Column, directive: str) -> Column:
    return F.coalesce(value, F.lit("")).rlike(rf"(?i)(^|[\s,]){re.escape(directive)}($|[\s,])")


def valid_language(tag: Column) -> Column:
    return F.coalesce((F.lower(tag) == "x-default") | tag.rlike(LANGUAGE), F.lit(False))


def utf16_length(x: Column) -> Column:
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def word_count(text: Column) -> Column:
    """Words of cleaned text; 0 for null or empty."""
    return F.when(empty(text), 0).otherwise(F.size(F.split(text, " "))).cast("int")


def content_hash(text: Column) -> Column:
    """Null for null or empty; ``text`` is computed once."""
    return F.nullif(F.sha2(F.lower(text), 256), F.lit(hashlib.sha256(b"").hexdigest()))


def group_key(x: Column) -> Column:
    """Key by which values count as equal: trimmed and in lower case; null for empty values."""
    return F.when(~empty(x), F.lower(F.regexp_replace(x, f"^{WS}+|{WS}+$", "")))


def json_string(x: Column) -> Column:
    """A string as JSON text; null stays null."""
    return F.when(x.isNotNull(), F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def fingerprint(rule: Column, scope: Column, url: Column, identity: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", rule, scope, url, identity), 256), 1, 24)


def glob_regex(pattern: str) -> str:
    """``**`` matches anything, ``*`` anything but slashes, all else itself; the whole string has to match."""
    parts = re.split(r"(\*\*|\*)", pattern)
    return "^" + "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in parts) + "$"
