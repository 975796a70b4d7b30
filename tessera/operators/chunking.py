"""From documents or pages to rows of the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx
from tessera.functions.redact import Redaction, redact
from tessera.functions.vectors import Backend, embed
from tessera.schema import migrate


def stored_page_type(page_type: Column) -> Column:
    """What is stored for a page's type; sections and images count as text."""
    return F.when(page_type.isin("section", "image"), F.lit("text")).otherwise(page_type)


def pages_of_sections(df: DataFrame, sections: Column, page_type: str = "section") -> DataFrame:
    """P5: a page for each section, numbered from 1, with the number of sections. Other columns stay.

    Texts without sections fall away behind the explosion: of a plain one Spark infers a filter below it, which makes the
    sections, and what they are made of, twice.
    """
    return (
        df.withColumn("_sections", sections)
        .select("*", F.size("_sections").alias("total_pages"), F.posexplode_outer("_sections").alias("_at", "text"))
        .where(F.col("_at").isNotNull())
        .withColumn("page_number", F.col("_at") + 1)
        .withColumn("page_type", F.lit(page_type))
        .drop("_sections", "_at")
    )


def inline_pages(df: DataFrame, text_col: str = "content", kind: Column | None = None) -> DataFrame:
    """Pages of inline texts (document_name, ``text_col``) by format; html text must be made Markdown before."""
    named = df.select("document_name", F.lit("").alias("document_path"), F.col(text_col).alias("_text"), *[c for c in df.columns if c not in ("document_name", "document_path", text_col)])
    return pages_of_sections(named, tx.sections(F.col("_text"), kind if kind is not None else F.lit("auto"))).drop("_text")


def chunk_pages(
    pages: DataFrame,
    now: Column,
    collection: Column | None = None,
    source_format: Column | None = None,
    max_chars: int = tx.MAX_CHARS,
    overlap_chars: int = tx.OVERLAP_CHARS,
    index: str = "document",
) -> DataFrame:
    """Rows of the chunk table (without vectors) from pages.

    ``chunk_index`` counts from 0 within a document, by page and place (``index='page'`` counts within the page). The
    page's raw text is repeated as it is; blank pages give nothing. A document's pages meet in one window partition, of
    which a document, not a collection, is the largest.
    """
    have = set(pages.columns)
    extra = lambda name: F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")
    collection = collection if collection is not None else F.col("collection") if "collection" in have else F.lit("default")
    source_format = source_format if source_format is not None else extra("source_format")
    rows = pages.select(
        "document_name",
        extra("document_path").alias("document_path"),
        collection.alias("collection"),
        F.col("page_number").cast("int").alias("page_number"),
        F.col("total_pages").cast("int").alias("total_pages"),
        F.col("text").alias("page_raw_text"),
        stored_page_type(F.col("page_type")).alias("page_type"),
        source_format.alias("source_format"),
        now.cast("timestamp").alias("ingestion_timestamp"),
        *[extra(c).alias(c) for c in ("agent_handle", "memory_type", "summary")],
        F.posexplode_outer(tx.chunk(F.col("text"), max_chars, overlap_chars)).alias("_place", "text"),
    ).where(F.col("_place").isNotNull())  # as in pages_of_sections
    if index == "page":
        rows = rows.withColumn("chunk_index", F.col("_place").cast("int"))
    else:
        order = Window.partitionBy("collection", "document_name").orderBy("page_number", "_place")
        rows = rows.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int"))
    return rows.drop("_place")


def scrub_pages(pages: DataFrame, config: Redaction = Redaction()) -> DataFrame:
    """Names, summaries and texts redacted before anything is chunked."""
    touched = {c: redact(F.col(c), config) for c in ("document_name", "summary", "text") if c in pages.columns}
    return pages.withColumns(touched)


def with_vectors(chunks: DataFrame, backend: Backend) -> DataFrame:
    """The vector of each chunk's own text, in the row itself, and the full schema."""
    return migrate(chunks.withColumn("vector", embed(F.col("text"), backend)))


def ingest(pages: DataFrame, now: Column, backend: Backend | None = None, scrub: Redaction | None = None, **options) -> DataFrame:
    """Pages to chunk rows: redact if asked, chunk, embed if a backend is given."""
    chunks = chunk_pages(scrub_pages(pages, scrub) if scrub else pages, now, **options)
    return with_vectors(chunks, backend) if backend else migrate(chunks)


def ingest_summary(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document, chunks and pages by class, as JSON without the counts that are absent."""
    by_class = pages.groupBy("document_name").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(F.col("page_type") == "text").alias("text_pages"),
        F.count_if(F.col("page_type") == "image").alias("image_pages"),
        F.count_if(F.col("page_type") == "section").alias("sections"),
    )
    made = chunks.groupBy("document_name", "collection").agg(F.count(F.lit(1)).alias("chunks"))
    joined = by_class.join(made, "document_name")
    fields = [F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("total_pages", "text_pages", "image_pages", "sections")]
    return joined.select("document_name", "collection", "chunks", F.to_json(F.struct("chunks", *fields)).alias("summary"))


def is_deterministic(pages: DataFrame) -> DataFrame:
    """Per document, whether no page came from character recognition; ask before page types are stored."""
    return pages.groupBy("document_name").agg(F.bool_and(F.col("page_type") != "image").alias("deterministic"))
