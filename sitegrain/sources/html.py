"""HTML pages to records: one Arrow-based function, as no built-in operator parses HTML."""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.urls import normalize

#: Rows and bytes of a batch that goes to a Python worker at most, and of HTML whose records a worker holds at once (or one page).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
SLICE_ROWS, SLICE_BYTES = 100, 1 << 20

#: What counts as white space.
_BLANKS = re.compile(r"[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
_HIDDEN = {"script", "style", "noscript", "template"}
S = pa.string()
OG = pa.struct([("title", S), ("description", S), ("image", S)])
TWITTER = pa.struct([("card", S), ("title", S), ("description", S), ("image", S)])
FIELDS = [
    ("title", S), ("description", S), ("robots", S), ("canonical", S), ("canonical_raw", S), ("lang", S), ("h1_count", pa.int32()), ("og", OG), ("twitter", TWITTER),
    ("hreflang", pa.list_(pa.struct([("lang", S), ("url", S)]))), ("json_ld", pa.list_(pa.struct([("valid", pa.bool_()), ("value", S), ("error", S)]))),
    ("images", pa.list_(pa.struct([("src", S), ("alt", S)]))), ("links", pa.list_(S)), ("internal_links", pa.list_(S)), ("external_links", pa.list_(S)), ("visible_text", S),
]
SCHEMA = (
    "title string, description string, robots string, canonical string, canonical_raw string, lang string, h1_count int, og struct<title:string,description:string,image:string>, "
    "twitter struct<card:string,title:string,description:string,image:string>, hreflang array<struct<lang:string,url:string>>, json_ld array<struct<valid:boolean,value:string,error:string>>, "
    "images array<struct<src:string,alt:string>>, links array<string>, internal_links array<string>, external_links array<string>, visible_text string"
)


def clean(text: str | None) -> str | None:
    return _BLANKS.sub(" ", text or "").strip(" ") or None


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


class PageParser(HTMLParser):
    """Collects what the audit needs, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: dict = {"h1_count": 0, "og": dict.fromkeys(OG.names), "twitter": dict.fromkeys(TWITTER.names), "hreflang": [], "json_ld": [], "images": [], "links": []}
        self.hidden: list[str] = []
        self.title: list[str] | None = None
        self.data: list[str] | None = None
        self.text: list[str] = []

    def _first(self, key: str, value: str | None) -> None:
        if value and not self.out.get(key):
            self.out[key] = value

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given: dict = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if tag == "title":
            self.title = []
        elif tag in _HIDDEN:
            self.hidden.append(tag)
            if tag == "script" and given.get("type", "").lower() == "application/ld+json":
                self.data = []
        handler = getattr(self, f"_{tag}", None)
        if handler:
            handler(given)

    def _html(self, a: dict) -> None:
        self._first("lang", clean(a.get("lang")))

    def _h1(self, _a: dict) -> None:
        self.out["h1_count"] += 1

    def _meta(self, a: dict) -> None:
        name, prop, content = a.get("name", "").lower(), a.get("property", "").lower(), clean(a.get("content"))
        if name in ("description", "robots") and self.out.get(name) is None:
            self._first(name, content)
        elif prop.startswith("og:") and prop[3:] in self.out["og"]:
            self.out["og"][prop[3:]] = self.out["og"][prop[3:]] or content
        elif name.startswith("twitter:") and name[8:] in self.out["twitter"]:
            self.out["twitter"][name[8:]] = self.out["twitter"][name[8:]] or content

    def _link(self, a: dict) -> None:
        rel, href = a.get("rel", "").lower().split(), clean(a.get("href"))
        if "canonical" in rel:
            self._first("canonical_raw", href)
        lang = clean(a.get("hreflang"))
        if "alternate" in rel and lang and href:
            self.out["hreflang"].append({"lang": lang, "url": href})

    def _a(self, a: dict) -> None:
        if a.get("href"):
            self.out["links"].append(a["href"])

    def _img(self, a: dict) -> None:
        self.out["images"].append({"src": clean(a.get("src")), "alt": a.get("alt")})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in _HIDDEN or tag == "title":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.title is not None:
            self._first("title", clean("".join(self.title)))
            self.title = None
        elif self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
            if tag == "script" and self.data is not None:
                self._block("".join(self.data))
                self.data = None

    def _block(self, text: str) -> None:
        if not text.strip():
            return
        try:
            value = json.loads(text, parse_constant=_no_constant)
            self.out["json_ld"].append({"valid": True, "value": json.dumps(value, ensure_ascii=False, separators=(",", ":")), "error": None})
        except (ValueError, RecursionError) as e:
            self.out["json_ld"].append({"valid": False, "value": None, "error": str(e)})

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...``, which HTML does not have, ends at the next ``>``."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data: str) -> None:
        if self.data is not None:
            self.data.append(data)
        if self.title is not None:
            self.title.append(data)
        if not self.hidden and (text := clean(data)):
            self.text.append(text)


def extract(html: str | None, url: str | None, final_url: str | None = None, include_query: bool = False) -> dict:
    """The record of one page; a null page has empty fields. Relative URLs count from ``final_url``, where redirects led; links keep queries if asked for.

    Of a page that the parser gives up on, what it had read counts.
    """
    parser = PageParser()
    with contextlib.suppress(AssertionError, RecursionError):
        parser.feed(html or "")
        parser.close()
    out = parser.out
    base = final_url or url
    out["canonical"] = normalize(out.get("canonical_raw"), base, include_query=True)
    out["hreflang"] = [{"lang": h["lang"], "url": normalize(h["url"], base, include_query=True)} for h in out["hreflang"]]
    found = sorted({n for x in out["links"] if (n := normalize(x, base, include_query))})
    own = normalize(url, None) or ""
    home = "/".join(own.split("/")[:3])
    out["links"] = found
    out["internal_links"] = [x for x in found if "/".join(x.split("/")[:3]) == home]
    out["external_links"] = [x for x in found if "/".join(x.split("/")[:3]) != home]
    out["visible_text"] = " ".join(parser.text)
    return {name: out.get(name) for name, _ in FIELDS}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of at most ``SLICE_ROWS`` rows and, unless it is one page, ``SLICE_BYTES`` of HTML."""
    for batch in batches:
        start = held = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch["html"]), 0).to_pylist()):
            if i > start and (i - start == SLICE_ROWS or held + size > SLICE_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def _run(include_query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            names = batch.schema.names
            final = batch["final_url"].to_pylist() if "final_url" in names else [None] * batch.num_rows
            rows = [extract(h, u, f, include_query) for h, u, f in zip(batch["html"].to_pylist(), batch["url"].to_pylist(), final, strict=True)]
            made = [pa.array([r[name] for r in rows], kind) for name, kind in FIELDS]
            keep = [name for name in names if name != "html"]
            yield pa.RecordBatch.from_arrays([*[batch[name] for name in keep], *made], names=[*keep, *[name for name, _ in FIELDS]])

    return run


def extract_pages(pages: DataFrame, include_query: bool = False) -> DataFrame:
    """``pages`` (url, html, perhaps final_url, other columns) with the extracted fields in place of html; html goes no further than this.

    What a worker holds does not grow with the table. Lowers the session's limits on batches to ``BATCH`` where they are higher.
    """
    for key, most in BATCH.items():
        now = pages.sparkSession.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            pages.sparkSession.conf.set(key, most)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "html")
    out = pages.mapInArrow(_run(include_query), f"{kept}, {SCHEMA}")
    from ..functions.text import content_hash, word_count

    return out.withColumn("word_count", word_count(F.col("visible_text"))).withColumn("content_hash", content_hash(F.col("visible_text")))
