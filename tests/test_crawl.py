"""Sites crawled to a fixed point, and pages put in by URL, sitemap or by what a URL is."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions.redact import Redaction
from tessera.sources.crawl import WELL_KNOWN, crawl, discovery_starts, fetched_from, ingest_auto, ingest_sitemap, ingest_urls, sitemap_entries

INDEX = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</sitemapindex>'
SET = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'


def maps(*names):
    return INDEX.format("".join(f"<sitemap><loc>https://a.test/{n}</loc></sitemap>" for n in names))


def pages(*names):
    return SET.format("".join(f"<url><loc>https://a.test/{n}</loc><lastmod>2026-01-0{k + 1}</lastmod></url>" for k, n in enumerate(names)))


WEB = {
    "robots.txt": "User-agent: *\nDisallow: /x\nSitemap: https://a.test/top.xml\nsitemap: http://127.0.0.1/inside.xml",
    "top.xml": maps("one.xml", "two.xml", "top.xml", "broken.xml"),
    "one.xml": maps("deep.xml", "two.xml"),
    "two.xml": pages("docs/b", "docs/c", "blog/x"),
    "deep.xml": maps("deepest.xml", "one.xml"),
    "deepest.xml": pages("docs/a", "docs/b"),
    "broken.xml": "<urlset><url>",
    **{f"docs/{n}": f"<html><title>{n}</title><body><p>Text of {n}, write to joe@example.com.</p></body></html>" for n in "abc"},
    "blog/x": "<html><body><p>Blog.</p></body></html>",
    "alone": "<p>Alone.</p>",
}
def now():
    return F.lit("2026-03-01 00:00:00")



@pytest.fixture
def web(spark):
    return fetched_from(spark.createDataFrame([(f"https://a.test/{n}", b) for n, b in WEB.items()], "url string, html string"))


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame([("https://a.test/docs/b", "web", "2026-02-01 00:00:00")], "document_name string, collection string, ingestion_timestamp string")


def starts(spark, *names):
    return spark.createDataFrame([(f"https://a.test/{n}", [k]) for k, n in enumerate(names)], "url string, place array<long>")


def test_crawl_ends_at_a_cycle_and_keeps_the_first_place(spark, web):
    found = crawl(starts(spark, "top.xml"), web).orderBy("place").collect()
    assert [r["loc"][15:] for r in found] == ["docs/a", "docs/b", "docs/c", "blog/x"]
    assert [r["place"] for r in found] == [[0, 0, 0, 0, 0], [0, 0, 0, 0, 1], [0, 1, 1], [0, 1, 2]] and str(found[1]["lastmod"]) == "2026-01-02 00:00:00"
    by_robots = crawl(discovery_starts(spark.createDataFrame([("https://a.test/docs/",), ("https://a.test/",)], "url string")), web)
    assert by_robots.count() == 4 and discovery_starts(spark.createDataFrame([("https://a.test",)], "url string")).count() == len(WELL_KNOWN)
    assert crawl(starts(spark, "none.xml"), web).count() == 0


def test_kinds_of_sitemaps():
    rss = "<?xml version='1.0'?><rss><channel><link>https://a/</link><item><link>https://a/1</link><pubDate>now</pubDate></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="https://a/2"/><updated>2026-01-01T00:00:00Z</updated></entry></feed>'
    assert sitemap_entries(rss) == [("https://a/1", "now", False)] and sitemap_entries(atom) == [("https://a/2", "2026-01-01T00:00:00Z", False)]
    assert sitemap_entries("﻿https://a/3\n no\nhttps://a/4 \n") == [("https://a/3", None, False), ("https://a/4", None, False)]
    assert sitemap_entries("<urlset><url>") == [] and sitemap_entries("") == []


def test_ingest_of_a_sitemap(spark, web, catalog):
    site = ingest_sitemap(starts(spark, "top.xml"), web, catalog, now(), include=["/docs/*"], scrub=Redaction())
    outcomes = {r["loc"][15:]: (r["kept"], r["skip"], r["error"]) for r in site.outcomes.collect()}
    assert outcomes == {"docs/a": (True, False, None), "docs/b": (True, True, None), "docs/c": (True, False, None), "blog/x": (False, False, None)}
    assert tuple(site.totals.first()) == (4, 3, 2, 1, 0)
    rows = site.chunks.orderBy("document_name").collect()
    assert [r["document_name"] for r in rows] == ["https://a.test/docs/a", "https://a.test/docs/c"] and "joe@" not in rows[0]["text"] and "Text of a" in rows[0]["text"]
    assert tuple(ingest_sitemap(starts(spark, "top.xml"), web, catalog, now(), limit=1, overwrite=True).totals.first()) == (4, 1, 1, 0, 0)


def test_failures_leave_other_pages_alone(spark, web):
    urls = ["https://a.test/alone", "https://a.test/none", "http://10.0.0.1/x"]
    site = ingest_urls(spark.createDataFrame([(u, True, False) for u in urls], "loc string, kept boolean, skip boolean"), web, now())
    assert {r["loc"]: r["error"] for r in site.outcomes.collect()} == dict(zip(urls, (None, "not found", "unsafe URL")))
    assert [r["text"] for r in site.chunks.collect()] == ["Alone."] and tuple(site.totals.first()) == (3, 3, 1, 0, 2)


def test_ingest_by_what_a_url_is(spark, web, catalog):
    def names(url):
        sites = ingest_auto(spark.createDataFrame([(url,)], "url string"), web, catalog.limit(0), now())
        return sorted(r["document_name"][15:] for s in sites for r in s.chunks.select("document_name").distinct().collect())

    assert names("https://a.test/docs/") == ["docs/a", "docs/b", "docs/c"]
    assert names("https://a.test/alone") == ["alone"]
