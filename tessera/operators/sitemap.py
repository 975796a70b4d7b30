"""Sitemap entries against the catalog."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.urls import is_safe, passes


def entries(sitemaps: DataFrame) -> DataFrame:
    """(loc, lastmod, nested) of sitemap documents (url, xml, order), each location once, the first winning.

    Entries of a sitemap index have ``nested`` true: fetch those and call again.
    """

    def parsed(frames):
        for frame in frames:
            rows = []
            for url, xml, order in zip(frame["url"], frame["xml"], frame["order"]):
                try:
                    root = ET.fromstring(xml)
                except ET.ParseError:
                    continue
                for at, node in enumerate(root):
                    found = {child.tag.rpartition("}")[2]: (child.text or "").strip() for child in node}
                    if found.get("loc"):
                        rows.append((url, int(order), at, found["loc"], found.get("lastmod"), node.tag.endswith("sitemap")))
            yield pd.DataFrame(rows, columns=["url", "order", "at", "loc", "lastmod", "nested"])

    rows = sitemaps.select("url", "xml", "order").mapInPandas(parsed, "url string, order long, at long, loc string, lastmod string, nested boolean")
    first = rows.groupBy("loc").agg(F.min_by(F.struct("lastmod", "nested", "order", "at"), F.struct("order", "at")).alias("e"))
    return first.select("loc", F.try_to_timestamp("e.lastmod").alias("lastmod"), "e.nested", "e.order", "e.at")


def freshness(found: DataFrame, catalog: DataFrame, collection: str, overwrite: bool = False) -> DataFrame:
    """Entries with ``skip``: known, not to be overwritten, and not changed since (lastmod <= stored time).

    An unreadable stored time or a missing lastmod is no reason to skip.
    """
    known = catalog.where(F.col("collection") == collection).select(F.col("document_name").alias("loc"), F.try_to_timestamp(F.col("ingestion_timestamp").cast("string")).alias("stored"))
    skip = F.coalesce(F.col("lastmod") <= F.col("stored"), F.lit(False)) & F.lit(not overwrite)
    return found.join(known.groupBy("loc").agg(F.max("stored").alias("stored")), "loc", "left").withColumn("skip", skip)


def select_safe(found: DataFrame, order: list[str], include: list[str] | None = None, exclude: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Matching entries that are safe to fetch, the first ``limit`` of those in order (0: all)."""
    rows = found.where(passes(F.col("loc"), include, exclude)).where(is_safe(F.col("loc")))
    return rows.orderBy(*order).limit(limit) if limit else rows


def crawl_totals(planned: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The result row of a crawl: discovered, after the filter, ingested, skipped, failed, and the errors."""
    rows = planned.join(outcomes.select("loc", "error"), "loc", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("total_discovered"),
        F.count_if("kept").alias("after_filter"),
        F.count_if(F.col("kept") & ~F.col("skip") & F.col("error").isNull()).alias("ingested"),
        F.count_if(F.col("kept") & F.col("skip")).alias("skipped"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def first_by_url(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") == 1).drop("_n")
