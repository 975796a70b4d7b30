"""Sites crawled by their sitemaps to a fixed point, and pages put in by URL, by sitemap or by what a URL is."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.html import html_pages
from tessera.functions.redact import Redaction
from tessera.functions.urls import bare_url, is_safe, is_sitemap, part, passes, path_include
from tessera.functions.vectors import Backend
from tessera.operators import chunking
from tessera.operators.scratch import scratch
from tessera.operators.sitemap import crawl_totals, freshness

#: Names under which a site's sitemap is looked for beside what its robots.txt says.
WELL_KNOWN = ("robots.txt", "sitemap.xml", "sitemap_index.xml", "sitemap-index.xml", "sitemap.txt")
ENTRY = "loc string, lastmod string, nested boolean, place array<long>"
#: (url) to (url, body, error): how documents are fetched; the body is null where there is an error.
Fetch = Callable[[DataFrame], DataFrame]


def fetched_from(web: DataFrame, url_col: str = "url", body_col: str = "html") -> Fetch:
    """Documents of a table of stored ones, in place of a network; the first body of a URL counts."""
    bodies = web.groupBy(F.col(url_col).alias("url")).agg(F.min(body_col).alias("body"))

    def fetch(urls: DataFrame) -> DataFrame:
        found = urls.select("url").join(bodies, "url", "left")
        return found.withColumn("error", F.when(F.col("body").isNull(), "not found"))

    return fetch


def sitemap_entries(body: str) -> list[tuple[str, str | None, bool]]:
    """(loc, lastmod, nested) of one document: a sitemap or an index in XML, RSS or Atom, a robots.txt, or a plain list."""
    text = body.lstrip("\ufeff \t\r\n")
    if not text.startswith("<"):
        named = re.findall(r"(?im)^\s*sitemap\s*:\s*(\S+)", text)
        return [(loc, None, True) for loc in named] or [(line.strip(), None, False) for line in text.splitlines() if re.match(r"\s*https?://\S+\s*$", line)]
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return []
    plain = lambda tag: tag.rpartition("}")[2]
    found = []
    for node in root.iter():
        kind = plain(node.tag) if isinstance(node.tag, str) else ""
        if kind not in ("url", "sitemap", "item", "entry"):
            continue
        fields: dict[str, str] = {}
        for child in node:
            name = plain(child.tag) if isinstance(child.tag, str) else ""
            fields.setdefault(name, (child.text or child.get("href") or "").strip())
        loc = fields.get("loc") or fields.get("link")
        if loc:
            found.append((loc, fields.get("lastmod") or fields.get("updated") or fields.get("pubDate"), kind == "sitemap"))
    return found


def crawl(start: DataFrame, fetch: Fetch, deepest: int = 64) -> DataFrame:
    """(loc, lastmod, place) of all pages that the sitemaps ``start`` (url, place) lead to, each location once: the first in the
    order of ``place``, a page's position in its sitemap after that of the sitemap, so an index's sitemaps follow where they
    stand in it. A sitemap that several name stands where the first round that found it has it.

    Rounds fetch the sitemaps that the last round named and no round before has seen, so a cycle ends. Every round is written before the next. Unsafe URLs aren't fetched.
    """
    spark, store = start.sparkSession, scratch(start.sparkSession, "crawl")

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (loc, lastmod, nested, [*place, at]) for body, place in zip(frame["body"], frame["place"]) for at, (loc, lastmod, nested) in enumerate(sitemap_entries(body))
            ]
            yield pd.DataFrame(rows, columns=["loc", "lastmod", "nested", "place"])

    def once(rows: DataFrame) -> DataFrame:
        return rows.groupBy("url").agg(F.min("place").alias("place"))

    frontier = once(start.select("url", F.col("place").cast("array<long>").alias("place")))
    rounds: list[DataFrame] = []
    seen = frontier.select("url").limit(0)
    for depth in range(deepest):
        frontier.write.parquet(f"{store}/asked-{depth}")
        asked = spark.read.schema("url string, place array<long>").parquet(f"{store}/asked-{depth}")
        bodies = fetch(asked.where(is_safe(F.col("url"))).select("url")).where("body IS NOT NULL")
        found = asked.join(bodies.select("url", "body"), "url").select("body", "place").mapInPandas(parsed, ENTRY)
        found.write.parquet(f"{store}/found-{depth}")
        rounds.append(spark.read.schema(ENTRY).parquet(f"{store}/found-{depth}"))
        seen = seen.unionByName(asked.select("url"))
        frontier = once(rounds[-1].where("nested").select(F.col("loc").alias("url"), "place")).join(seen, "url", "left_anti")
        if frontier.isEmpty():
            break
    pages = reduce(DataFrame.unionByName, rounds).where("NOT nested")
    first = pages.groupBy("loc").agg(F.min_by(F.struct("lastmod", "place"), "place").alias("e"))
    return first.select("loc", F.try_to_timestamp("e.lastmod").alias("lastmod"), "e.place")


def discovery_starts(urls: DataFrame) -> DataFrame:
    """(url, place): where the sitemaps of the sites of ``urls`` (url) are looked for: robots.txt, then the usual names."""
    site = F.concat(part(F.col("url"), "PROTOCOL"), F.lit("://"), part(F.col("url"), "AUTHORITY"))
    named = urls.select(site.alias("site")).distinct().select("site", F.posexplode(F.array(*map(F.lit, WELL_KNOWN))).alias("at", "name"))
    return named.select(F.concat("site", F.lit("/"), "name").alias("url"), F.array(F.col("at").cast("long")).alias("place"))


class Site(NamedTuple):
    """chunks to put in place of their documents; outcomes (loc, kept, skip, error) of each page; totals in one row."""

    chunks: DataFrame
    outcomes: DataFrame
    totals: DataFrame


def ingest_urls(urls: DataFrame, fetch: Fetch, now: Column, backend: Backend | None = None, scrub: Redaction | None = None, collection: str = "web") -> Site:
    """The pages of ``urls`` (loc, kept, skip), fetched if they are kept, not skipped and safe, as chunks of documents named by URL.

    A document's name is scheme, host, port and path, when names are redacted. A page that can't be fetched, or has no text,
    is told with its error and leaves the others alone.
    """
    wanted = urls.withColumn("safe", is_safe(F.col("loc")))
    store = scratch(urls.sparkSession, "pages")
    fetch(wanted.where("kept AND NOT skip AND safe").select(F.col("loc").alias("url")).distinct()).write.parquet(store)
    got = urls.sparkSession.read.schema("url string, body string, error string").parquet(store)
    pages = html_pages(got.where("body IS NOT NULL").select("url", F.col("body").alias("html")))
    name = bare_url(F.col("document_name"), scrub) if scrub else F.col("document_name")
    pages = pages.withColumns({"document_name": name, "collection": F.lit(collection), "source_format": F.lit(".html")})
    chunks = chunking.ingest(pages, now, backend, scrub)
    error = F.when(F.col("kept") & ~F.col("skip"), F.when(~F.col("safe"), "unsafe URL").otherwise(F.coalesce("error", F.when(F.col("url").isNull(), "not fetched"))))
    outcomes = wanted.join(got.select("url", "error"), F.col("loc") == F.col("url"), "left").select("loc", "kept", "skip", error.alias("error"))
    return Site(chunks, outcomes, crawl_totals(outcomes.drop("error"), outcomes.select("loc", "error")))


def ingest_sitemap(
    start: DataFrame,
    fetch: Fetch,
    catalog: DataFrame,
    now: Column,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    limit: int = 0,
    overwrite: bool = False,
    backend: Backend | None = None,
    scrub: Redaction | None = None,
    collection: str = "web",
) -> Site:
    """All pages that sitemaps ``start`` (url, place) lead to: those that the globs pass, the first ``limit`` of them,
    without those that ``catalog`` has and that did not change since.
    """
    found = freshness(crawl(start, fetch), catalog, collection, overwrite)
    kept = passes(F.col("loc"), include, exclude)
    rows = found.withColumn("kept", F.coalesce(kept, F.lit(False)))
    if limit:
        first = rows.where("kept").orderBy("place").limit(limit).select("loc", F.lit(True).alias("first"))
        rows = rows.join(F.broadcast(first), "loc", "left").withColumn("kept", F.coalesce("first", F.lit(False))) if limit <= 100_000 else rows.join(first, "loc", "left_semi")
    return ingest_urls(rows.select("loc", "kept", "skip"), fetch, now, backend, scrub, collection)


def ingest_auto(urls: DataFrame, fetch: Fetch, catalog: DataFrame, now: Column, **options) -> list[Site]:
    """Each of ``urls`` (url) by what it is: a sitemap by its name is crawled; for another, its site's sitemaps are looked for, and of what
    they list the pages at its path and below are taken; a URL that no such page is found for is one page.

    The set of ``urls`` is the caller's list; each path is a set of globs of its own, so there is a crawl for each site.
    """
    rows = urls.select("url", is_sitemap(F.col("url")).alias("sitemap"), F.coalesce(part(F.col("url"), "PATH"), F.lit("")).alias("path")).distinct().collect()
    spark, made, single = urls.sparkSession, [], []
    named = [r["url"] for r in rows if r["sitemap"]]
    if named:
        start = spark.createDataFrame([(u, [k]) for k, u in enumerate(sorted(named))], "url string, place array<long>")
        made.append(ingest_sitemap(start, fetch, catalog, now, **options))
    for r in sorted((r for r in rows if not r["sitemap"]), key=lambda r: r["url"]):
        one = spark.createDataFrame([(r["url"],)], "url string")
        site = ingest_sitemap(discovery_starts(one), fetch, catalog, now, include=path_include(r["path"]), **options)
        if site.outcomes.where("kept").isEmpty():
            single.append(r["url"])
        else:
            made.append(site)
    if single:
        known = freshness(spark.createDataFrame([(u, None) for u in single], "loc string, lastmod timestamp"), catalog, options.get("collection", "web"), options.get("overwrite", False))
        direct = {k: v for k, v in options.items() if k in ("backend", "scrub", "collection")}
        made.append(ingest_urls(known.select("loc", F.lit(True).alias("kept"), "skip"), fetch, now, **direct))
    return made
