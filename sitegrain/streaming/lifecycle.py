"""Lifecycles on a stream of snapshots, with the issues of each page as keyed state.

A snapshot enters as one event for each page that it checked, with the page's issues, and one for each site, with the
issues that concern the site as a whole. The state of a page (or site) is what its last snapshot found. Pages that a
snapshot did not check have no event, so their issues are neither repeated nor resolved. State is a page's issues, so
no key grows with the site.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import diff

ISSUE = ["rule", "severity", "scope", "url", "message", "evidence"]
EVENT = f"seq long, snapshot_id string, place string, checked boolean, issues array<struct<fingerprint:string,{','.join(f'{c}:string' for c in ISSUE)}>>"
OUT = f"seq long, snapshot_id string, fingerprint string, {', '.join(f'{c} string' for c in ISSUE if c != 'evidence')}, before string, after string, lifecycle string"


def events(seq: int, issues: DataFrame, pages: DataFrame, sites: DataFrame) -> DataFrame:
    """The events of one snapshot, later ones having a higher ``seq``.

    ``issues`` as the audit gives them; ``pages``: (snapshot_id, url) of checked pages; ``sites``: (snapshot_id,
    complete). Issues of pages that were not checked, and of unknown sites, are events that resolve nothing.
    """
    found = diff.unique(issues).withColumn("place", F.when(F.col("scope") == "page", F.concat(F.lit("page "), "url")).otherwise("site"))
    lists = found.groupBy("snapshot_id", "place").agg(F.sort_array(F.collect_list(F.struct("fingerprint", *ISSUE))).alias("issues"))
    checked = pages.select("snapshot_id", F.concat(F.lit("page "), "url").alias("place"), F.lit(True).alias("checked")).distinct()
    checked = checked.unionByName(sites.select("snapshot_id", F.lit("site").alias("place"), F.col("complete").alias("checked")))
    both = checked.join(lists, ["snapshot_id", "place"], "full_outer")
    none = F.array().cast(EVENT.split("issues ")[1])
    return both.select(F.lit(seq).cast("long").alias("seq"), "snapshot_id", "place", F.coalesce("checked", F.lit(False)).alias("checked"), F.coalesce("issues", none).alias("issues"))


def _step(known: dict, event, row: dict) -> Iterator[dict]:
    """What an event makes of the issues known so far."""
    now = {x["fingerprint"]: {c: x[c] for c in ISSUE} for x in event.issues}
    for fp, x in now.items():
        old = known.get(fp)
        state = "new" if old is None else "unchanged" if old["evidence"] == x["evidence"] else "ongoing"
        changed = state == "ongoing"
        yield row | {c: x[c] for c in ISSUE if c != "evidence"} | {"fingerprint": fp, "lifecycle": state, "before": old["evidence"] if changed else None, "after": x["evidence"] if changed else None}
    for fp, x in known.items():
        if fp not in now and event.checked:
            yield row | {c: x[c] for c in ISSUE if c != "evidence"} | {"fingerprint": fp, "lifecycle": "resolved", "before": None, "after": None}


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in OUT.split(", ")]
    known, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, None)
    rows: list[dict] = []
    for event in sorted((e for b in batches for e in b.itertuples()), key=lambda e: e.seq):
        if last is not None and event.seq <= last:
            continue  # a snapshot that is delivered again
        if event.seq > 0:  # the first snapshot is what the others are held against
            rows += _step(known, event, {"seq": event.seq, "snapshot_id": key[0]})
        last = int(event.seq)
        known = {x["fingerprint"]: {c: x[c] for c in ISSUE} for x in event.issues}
    state.update((json.dumps(known), last))
    yield pd.DataFrame(rows, columns=names)


def lifecycles(stream: DataFrame) -> DataFrame:
    """A stream of ``events`` to issues with lifecycle new, ongoing, unchanged or resolved, for each snapshot after the first."""
    return stream.groupBy("snapshot_id", "place").applyInPandasWithState(_advance, OUT, "known string, last long", "append", GroupStateTimeout.NoTimeout)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots replayed, with a restart between them; regressions are added as in the diff of tables."""
    from ..operators import current, regression
    from ..plans.crawl import shared_folder
    from ..sources import site_tables
    from .replay import run_available

    root = shared_folder(spark, "lifecycle")
    states = [site_tables.snapshot(spark, sf_dir, shift) for shift in (1, 0)]
    for seq, s in enumerate(states):
        audit = current.audit(s.pages, s.sites, s.sitemap_urls, with_urls=False)
        events(seq, audit, s.pages.select("snapshot_id", "url"), s.sites).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(EVENT).parquet(f"{root}/in")
        run_available(lifecycles(stream), f"{root}/out", f"{root}/state")
    out = spark.read.schema(OUT).parquet(f"{root}/out").drop("seq")
    b, a = states
    rows = diff.with_regressions(out, regression.regressions(b.pages, a.pages, b.sites, a.sites))
    ongoing = F.col("lifecycle") == "ongoing"
    return rows.select(*[F.when(~ongoing, F.col(c)).alias(c) if c in ("before", "after") else c for c in diff.FIELDS], (ongoing & F.col("before").isNotNull()).alias("has_both"))
