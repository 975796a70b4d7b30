"""Catalog reads over the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import document_selector


def list_documents(chunks: DataFrame, collection: str | None = None) -> DataFrame:
    """A1: a row for each document name, whatever its collections; the first row by (page, chunk) gives path,
    collection and page total.
    """
    rows = chunks.where(F.col("collection") == collection) if collection else chunks
    first = F.min_by(F.struct("document_path", "collection", "total_pages"), F.struct("page_number", "chunk_index", "collection"))
    return (
        rows.groupBy("document_name")
        .agg(
            first.alias("first"),
            F.count(F.lit(1)).alias("chunk_count"),
            F.countDistinct("page_number").alias("indexed_pages"),
            F.max("ingestion_timestamp").cast("string").alias("ingestion_timestamp"),
        )
        .select("document_name", "first.*", "chunk_count", "indexed_pages", "ingestion_timestamp")
    )


def list_collections(chunks: DataFrame) -> DataFrame:
    """A2: distinct documents and chunks of each collection, by name."""
    counted = chunks.groupBy("collection").agg(F.countDistinct("document_name").alias("document_count"), F.count(F.lit(1)).alias("chunk_count"))
    return counted.orderBy("collection")


def count_chunks(chunks: DataFrame, collection: str | None = None) -> DataFrame:
    """A3."""
    return (chunks.where(F.col("collection") == collection) if collection else chunks).agg(F.count(F.lit(1)).alias("chunk_count"))


def status(chunks: DataFrame, directories: DataFrame) -> DataFrame:
    """A4: counts in one row; documents are summed over collections, so one in two collections counts twice."""
    found = list_collections(chunks).agg(
        F.coalesce(F.sum("document_count"), F.lit(0)).alias("document_count"),
        F.count(F.lit(1)).alias("collection_count"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_count"),
    )
    return found.join(F.broadcast(directories.agg(F.count(F.lit(1)).alias("registered_directories"))), F.lit(True), "inner")


def database_documents(chunks: DataFrame) -> DataFrame:
    """A5: distinct document names over all collections, which can be fewer than A4 says."""
    return chunks.agg(F.countDistinct("document_name").alias("document_count"))


def page_text(chunks: DataFrame, document_name: str, page_number: int, collection: str | None = None) -> DataFrame:
    """The raw text of a page; no row if there is none."""
    rows = chunks.where(document_selector(document_name, collection) & (F.col("page_number") == page_number))
    return rows.orderBy("collection", "chunk_index").select("page_raw_text").limit(1)


def show(chunks: DataFrame, document_name: str, page_number: int | None = None, collection: str | None = None) -> DataFrame:
    """A document's catalog row, or the text of a page of it; a page below 1 is refused."""
    if page_number is None:
        return list_documents(chunks, collection).where(F.col("document_name") == document_name).limit(1)
    if page_number < 1:
        raise ValueError("page must be 1 or more")
    return page_text(chunks, document_name, page_number, collection)
