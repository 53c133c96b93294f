"""Allow and block rules for URLs by a sort-merge range join, in DataFrame operations only.

A rule (host, path) becomes the interval of all byte strings that begin with its canonical key: the host's
labels in reverse, a separator that no UTF-8 text contains, the path. URLs enter with the key of their host
and of each parent domain. Keys and interval ends are sorted together and swept once: an interval's start
pushes its rule on the stack, its end pops it, and the top of the stack is the longest rule that holds at a
key. Keys and ends are dealt to tasks by ranges of their common order, in which equal keys are told apart by a
hash, so no host or path, however common, loads one task; the stack that is open at a range's border is carried
over from the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import lookup, materialise

#: Fixed rules of the registered query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Verdict of a URL without a rule.
DEFAULT = "allow"
#: The top of the stack.
TOP = "struct<length:int,host_length:int,verdict:string,rule:string>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first "://" up to "/", "?" or "#"; path up to "?" or "#"; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def reverse_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def canonical_key(reversed_host: Column, path: Column) -> Column:
    return F.concat(F.encode(reversed_host, "UTF-8"), F.unhex(F.lit("FE")), F.encode(path, "UTF-8"))


def boundaries(rules: DataFrame) -> DataFrame:
    """Interval ends in (key), each with the rule on top of the stack from there on (``top``, its ``rule`` null if the stack is empty).

    Slot d of the stack is the rule opened last at depth d; after an end at depth d, that slot is the top again.
    """
    key = canonical_key(reverse_host(F.col("host")), F.col("path"))
    own = F.struct(F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"), "verdict", "rule")
    keyed = rules.select(key.alias("key"), "host", own.alias("own"))
    none = F.lit(None).cast(keyed.schema["own"].dataType)
    ends = keyed.select("key", "host", "own", F.lit(1).alias("step")).unionByName(keyed.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), "host", none.alias("own"), F.lit(-1).alias("step")))
    depth = ends.withColumn("depth", F.sum("step").over(Window.partitionBy("host").orderBy("key")))
    slot = F.last("own", ignorenulls=True).over(Window.partitionBy("host", "depth").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    empty = F.struct(F.lit(-1).alias("length"), F.lit(-1).alias("host_length"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule"))
    return depth.select("key", F.when(F.col("depth") > 0, slot).otherwise(empty).alias("top"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url", runs: int | None = None) -> DataFrame:
    """One row per input row: the id, host, path, rule (null without one) and verdict.

    ``rules`` has verdict, host, path. A rule fits its host and all subdomains if the path begins with the
    rule's. The longest host plus path wins, then the longest host. Of repeated (host, path) the greatest
    verdict in string order counts ("block" before "allow"); rules with a null field are left out, hosts are
    lower-cased. A null url, or one without "://", has empty host and path; it gets the default verdict unless
    a rule has an empty host. Repeated rows and null ids stay; other columns are left out.
    """
    spark = pages.sparkSession
    runs = runs or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna()
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("rule", F.concat("host", "path"))
    )
    deepest = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\.", -1))), F.lit(0))).first()[0]
    host, path = host_and_path(F.col(url_col))
    url_key = F.unhex(F.sha2(canonical_key(F.col("host"), F.col("path")), 256)).alias("url")
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).select("*", url_key)
    # Each pair once: a common URL becomes one row before anything is sorted.
    pairs = materialise(rows.groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.count("*").alias("n")))
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, deepest)))), lambda n: F.array_join(F.reverse(F.slice(labels, -n, n)), "."))
    keys = pairs.withColumn("parent", F.explode(parents)).select(canonical_key(F.col("parent"), F.col("path")).alias("key"), F.col("url"), F.lit(None).cast(TOP).alias("top"))
    ends = boundaries(rules).select("key", F.lit(None).cast("binary").alias("url"), "top")
    order = ["key", F.col("url").isNotNull(), "url"]  # ends before the keys that are equal to them
    events = materialise(keys.unionByName(ends).repartitionByRange(runs, *order).withColumn("run", F.spark_partition_id()))
    last = events.filter("top is not null").groupBy("run").agg(F.max_by("top", "key").alias("last"))
    # One row for each run.
    open_ = events.select("run").distinct().join(last, "run", "left").select("run", F.last("last", ignorenulls=True).over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    sweep = Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("top", F.last("top", ignorenulls=True).over(sweep)).filter("url is not null").join(F.broadcast(open_), "run")
    best = swept.withColumn("top", F.coalesce("top", "open")).filter("top.rule is not null").groupBy("url").agg(F.max("top").alias("best")).select("url", "best.rule", "best.verdict")
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = lookup(rows, best, "url", pairs.select("url", "n"), total)
    return out.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    rules = spark.sql(f"select * from values {values} as t(verdict, host, path)")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP10_SQL = """
with parts as (
  select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages
), split as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw_host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from parts
), hosts as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from split
), ruled as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/'
  end as rule from hosts
)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from ruled
"""
