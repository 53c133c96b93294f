"""Joins of texts with patterns: by the pattern's literal beginning first, then by regular expression.

A pattern's key is its whole literal beginning; a text has one key for each length that such beginnings have. So texts
and patterns meet by equality, and the regular expression is tried only where the beginnings agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Keys that many texts share are dealt to so many tasks; the patterns are repeated for each.
SALTS = 8


def escaped(pattern: Column) -> Column:
    """All characters but ``*`` as they are in a regular expression."""
    return F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|?])", r"\\$1")


def glob(pattern: Column) -> Column:
    """Like ``glob_regex``: ``**`` matches anything, ``*`` anything but slashes; the whole text has to match."""
    body = F.replace(F.replace(F.replace(escaped(pattern), F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]*")), F.lit("\x01"), F.lit(".*"))
    return F.concat(F.lit("^"), body, F.lit("$"))


def path_pattern(pattern: Column) -> Column:
    """Like ``pattern_regex``: ``*`` is anything, a last ``$`` the end; from the start of the path."""
    end = pattern.endswith("$")
    body = F.when(end, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    return F.concat(F.lit("^"), F.replace(escaped(body), F.lit("*"), F.lit(".*")), F.when(end, "$").otherwise(""))


def pattern_key(pattern: Column, end_mark: bool = False) -> Column:
    """The key of a pattern; ``end_mark``: a last ``$`` is not part of it."""
    start = F.substring_index(pattern, "*", 1)
    return F.regexp_replace(start, r"\$$", "") if end_mark else start


def salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salts() -> Column:
    """Each salt, for the patterns' side."""
    return F.explode(F.array(*map(F.lit, range(SALTS))))


def keyed(texts: DataFrame, known: DataFrame, by: str, text: str, *salted: str) -> DataFrame:
    """``texts`` with _salt and, in a row for each, the _key of patterns that can match ``text``; null where none can.

    ``known``: patterns with ``by``, _key and _salt (each of ``salts``). Both meet by ``by``, _key and _salt. Texts have keys of those lengths
    only that patterns of the same ``by`` have.
    """
    lengths = known.groupBy(by, "_salt").agg(F.collect_set(F.length("_key")).alias("_lengths"))
    own = texts.withColumn("_salt", salt(*salted)).join(lengths, [by, "_salt"], "left")
    keys = F.transform(F.filter("_lengths", lambda n: n <= F.length(text)), lambda n: F.substring(text, F.lit(1), n))
    return own.select(*texts.columns, "_salt", F.explode_outer(keys).alias("_key"))
