import gzip
import heapq
import random

from pyspark.sql import functions as F

from sitegrain.sources import sitemap_index

HOME = "https://e.com"


def plain(start, files, max_files, max_urls):
    """One site with a queue: (urls, files, truncated, error)."""
    queue, seen, taken, urls = [start], {start}, 0, []
    while queue and taken < max_files and len(urls) < max_urls:
        at = heapq.heappop(queue)
        taken += 1
        kind, locs = files.get(at, (None, []))
        if kind is None:
            return set(), 0, False, f"no sitemap at {at}"
        for loc in locs:
            if kind == "sitemapindex":
                if loc not in seen:
                    seen.add(loc), heapq.heappush(queue, loc)
            elif loc not in urls and len(urls) < max_urls:
                urls.append(loc)
    return set(urls), taken, taken >= max_files or len(urls) >= max_urls, None


def body(kind, locs):
    entry = {"sitemapindex": "sitemap", "urlset": "url"}[kind]
    return f"<{kind}>{''.join(f'<{entry}><loc>{u}</loc></{entry}>' for u in locs)}</{kind}>".encode()


def test_order_and_limits_against_a_queue(spark):
    """Random nested indexes with cycles, shared children and missing files, many sites at once."""
    rng, files, starts, plans = random.Random(5), [], [], {}
    for n in range(60):
        home = f"https://s{n}.example"
        names = [f"{home}/{rng.randrange(10**4)}-{i}.xml" for i in range(14)]
        own = {}
        for i, name in enumerate(names):
            if i < 6:
                own[name] = ("sitemapindex", rng.sample(names, rng.randrange(1, 6)))
            elif i < 13 or n % 4:
                own[name] = ("urlset", [f"{home}/p{rng.randrange(30)}" for _ in range(rng.randrange(0, 9))])
        files += [(name, bytearray(body(*v))) for name, v in own.items()]
        starts.append((home, names[0]))
        plans[home] = (names[0], own)
    table = spark.createDataFrame(files, "file string, body binary")
    for max_files, max_urls in ((100, 1000), (5, 1000), (100, 7)):
        urls, state = sitemap_index.load(spark.createDataFrame(starts, "site string, file string"), table, max_files, max_urls)
        got = {}
        for r in urls.collect():
            got.setdefault(r.site, []).append(r.url)
        rows = {r.site: r for r in state.collect()}
        assert len(rows) == 60
        for home, (start, own) in plans.items():
            want, taken, truncated, error = plain(start, own, max_files, max_urls)
            r = rows[home]
            assert (set(got.get(home, [])), r.files, r.truncated, r.error, r.urls) == (want, taken, truncated, error, len(want)), (home, max_files, max_urls)
            assert len(got.get(home, [])) == len(want)


def test_files_of_all_kinds(spark):
    files = {
        f"{HOME}/s.xml": body("sitemapindex", ["/a.xml.gz", "https://x.org/b.xml", " c.xml ", "/s.xml"]),
        f"{HOME}/a.xml.gz": gzip.compress(body("urlset", ["/1", "/1#top", "/2.pdf", "https://x.org/3", "ftp://e.com/4", "/q?x=1"])),
        f"{HOME}/c.xml": b'\xef\xbb\xbf<x:urlset xmlns:x="http://s.org"><x:url><x:loc>/3</x:loc></x:url><x:url><x:loc>/4</x:loc><x:loc>/5</x:loc></x:url><x:url/></x:urlset>',
    }
    bad = {"cut": b"<urlset><url>", "html": b"<html/>", "packed": b"\x1f\x8bnothing", "empty": b"", "null": None}
    rows = list(files.items()) + [(f"https://{k}.example/s.xml", v) for k, v in bad.items()] + [(None, b"x")]
    starts = [(HOME, f"{HOME}/s.xml"), *[(f"https://{k}.example", f"https://{k}.example/s.xml") for k in bad], ("https://none.example", "https://none.example/s.xml"), (None, "x"), ("https://n.example", None)]
    table = spark.createDataFrame([(f, None if b is None else bytearray(b)) for f, b in rows], "file string, body binary")
    urls, state = sitemap_index.load(spark.createDataFrame(starts, "site string, file string"), table)
    assert sorted(r.url for r in urls.collect()) == [f"{HOME}/1", f"{HOME}/3", f"{HOME}/q"]
    found = {r.site: r for r in state.collect()}
    assert found[HOME].files == 3 and found[HOME].error is None and not found[HOME].truncated
    assert len(found) == 7 and all(r.error and r.files == 0 for site, r in found.items() if site != HOME)
    empty = sitemap_index.load(spark.createDataFrame([], "site string, file string"), table)
    assert empty[0].count() == empty[1].count() == 0


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "e.com").mkdir()
    (tmp_path / "e.com" / "s.xml").write_bytes(body("sitemapindex", ["/m.xml.gz"]))
    (tmp_path / "e.com" / "m.xml.gz").write_bytes(gzip.compress(body("urlset", ["/a"])))
    files = sitemap_index.read_files(spark, str(tmp_path), F.concat(F.lit("https://"), F.regexp_extract("path", "([^/]+/[^/]+)$", 1)))
    urls, state = sitemap_index.load(spark.createDataFrame([(HOME, f"{HOME}/s.xml")], "site string, file string"), files)
    assert [r.url for r in urls.collect()] == [f"{HOME}/a"] and state.first().files == 2
