"""The given tables in the shapes of this library, each with the SQL that says the same.

Documents stand for chunks: five make one document of three pages, their source is the collection, and vectors are those of
equal id. Listings, registries and transcripts are derived from ids by rules, so that every branch of an operator occurs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import migrate

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and SQL for those that it can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of the chunk table.

    Where no id of a vector repeats, which a job over the ids tells, vectors are declared distinct by id: then Spark leaves the
    join out wherever no vector is asked for, and texts that are only read or tokenized are not shuffled. Keys are made below the
    join, so that a semi-join by them is taken to the documents.
    """
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    if vectors.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        vectors = vectors.dropDuplicates(["doc_id"])
    at = F.col("doc_id")
    name = F.concat(F.lit("doc-"), F.floor(at / 5).cast("string"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "text", name.alias("document_name"), F.concat(F.lit("/data/"), name).alias("document_path"), F.col("source").alias("collection"),
        (F.floor(at % 5 / 2) + 1).cast("int").alias("page_number"), F.lit(3).alias("total_pages"), (at % 5).cast("int").alias("chunk_index"), F.col("text").alias("page_raw_text"),
        F.when(at % 4 == 3, "code").otherwise("text").alias("page_type"), F.lit(".txt").alias("source_format"),
        F.timestamp_seconds(F.lit(1767225600) + at * 60).alias("ingestion_timestamp"), F.concat(F.lit("agent-"), (at % 3).cast("string")).alias("agent_handle"),
        F.when(at % 4 == 0, "fact").when(at % 4 == 1, "note").when(at % 4 == 2, "opinion").otherwise("").alias("memory_type"), F.col("lang").alias("summary"),
    )
    return migrate(rows.join(vectors, "doc_id", "left"))


CHUNKS = """
WITH chunks AS (
    SELECT d.text, v.embedding AS vector, 'doc-' || (d.doc_id // 5) AS document_name, '/data/doc-' || (d.doc_id // 5) AS document_path,
           d.source AS collection, CAST((d.doc_id % 5) // 2 + 1 AS INTEGER) AS page_number, CAST(3 AS INTEGER) AS total_pages,
           CAST(d.doc_id % 5 AS INTEGER) AS chunk_index, d.text AS page_raw_text,
           CASE WHEN d.doc_id % 4 = 3 THEN 'code' ELSE 'text' END AS page_type, '.txt' AS source_format,
           TIMESTAMP '2026-01-01 00:00:00' + to_minutes(CAST(d.doc_id AS INTEGER)) AS ingestion_timestamp, 'agent-' || (d.doc_id % 3) AS agent_handle,
           CASE d.doc_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'note' WHEN 2 THEN 'opinion' ELSE '' END AS memory_type, d.lang AS summary
    FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id
)"""


def registered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of files: nine documents of ten, some partly ingested, some without a hash."""
    at = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(at % 10 < 9).select(
        F.concat(F.lit("/w/"), "source", F.lit("/f"), at.cast("string"), F.lit(".txt")).alias("path"), F.col("source").alias("collection"),
        F.concat(F.lit("f"), at.cast("string"), F.lit(".txt")).alias("document_name"), (at + F.lit(0.5)).alias("mtime"), F.col("n_chars").alias("size"),
        F.lit("2026-01-01T00:00:00+00:00").alias("ingested_at"), F.when(at % 13 != 0, F.md5("text")).alias("content_hash"),
        (at % 3).cast("int").alias("chunks_committed"), F.when(at % 17 == 0, F.md5("text")).alias("partial_hash"),
    )


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the disk holds: some files gone, touched, grown, changed, vanished meanwhile or unreadable."""
    at = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(at % 7 != 0).select(
        F.concat(F.lit("/w/"), "source", F.lit("/f"), at.cast("string"), F.lit(".txt")).alias("path"),
        (at + F.lit(0.5) + F.when(at % 3 == 1, 1.0).otherwise(0.0)).alias("mtime"), (F.col("n_chars") + F.when(at % 5 == 0, 1).otherwise(0)).alias("size"),
        F.md5(F.concat("text", F.when(at % 4 == 0, "x").otherwise(""))).alias("content_hash"),
        F.when(at % 19 == 0, "unreadable").when(at % 23 == 0, "vanished").otherwise("ok").alias("status"),
    )


FILES = """
WITH files AS (
    SELECT '/w/' || source || '/f' || doc_id || '.txt' AS path, source AS collection, 'f' || doc_id || '.txt' AS document_name,
           CAST(doc_id + 0.5 AS DOUBLE) AS mtime, n_chars AS size, '2026-01-01T00:00:00+00:00' AS ingested_at,
           CASE WHEN doc_id % 13 <> 0 THEN md5(text) END AS content_hash, CAST(doc_id % 3 AS INTEGER) AS chunks_committed,
           CASE WHEN doc_id % 17 = 0 THEN md5(text) END AS partial_hash
    FROM documents WHERE doc_id % 10 < 9
), listing AS (
    SELECT '/w/' || source || '/f' || doc_id || '.txt' AS path, CAST(doc_id + 0.5 + CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS DOUBLE) AS mtime,
           n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size, md5(text || CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END) AS content_hash,
           CASE WHEN doc_id % 19 = 0 THEN 'unreadable' WHEN doc_id % 23 = 0 THEN 'vanished' ELSE 'ok' END AS status
    FROM documents WHERE doc_id % 7 <> 0
), planned AS (
    SELECT coalesce(l.path, f.path) AS path, f.collection, f.document_name, l.mtime AS new_mtime, l.size AS new_size, l.content_hash AS new_hash,
           CASE WHEN (l.status IS NULL OR l.status = 'vanished') AND f.path IS NULL THEN NULL
                WHEN l.status IS NULL OR l.status = 'vanished' THEN 'delete'
                WHEN f.path IS NULL OR f.partial_hash IS NOT NULL THEN 'ingest'
                WHEN f.mtime = l.mtime AND f.size = l.size THEN 'unchanged'
                WHEN l.status = 'unreadable' OR f.content_hash IS NULL OR f.size <> l.size THEN 'ingest'
                WHEN f.content_hash = l.content_hash THEN 'refresh' ELSE 'ingest' END AS action
    FROM listing l FULL JOIN files f ON l.path = f.path
)"""


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory for each source, one within another, and one registered below it."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("collection")).where(F.col("source").isNotNull()).distinct()
    rows = rows.select(F.concat(F.lit("/w/"), "collection").alias("directory"), "collection", F.lit("2026-01-01").alias("registered_at"))
    deep = spark.createDataFrame([("/w/src1/deep", "deep", "2026-01-02"), ("/v/src2/a/b", "lone", "2026-01-02")], rows.schema)
    return rows.unionByName(deep)


DIRECTORIES = """
WITH directories AS (
    SELECT DISTINCT '/w/' || source AS directory, source AS collection, '2026-01-01' AS registered_at FROM documents WHERE source IS NOT NULL
    UNION ALL SELECT '/w/src1/deep', 'deep', '2026-01-02' UNION ALL SELECT '/v/src2/a/b', 'lone', '2026-01-02'
)"""


def archived(spark: SparkSession) -> DataFrame:
    rows = [("src3", "2026-01-01", "/w/src3"), ("old", "2026-01-01", "/w/src3"), ("src4", "2026-01-01", "/elsewhere"), ("bare", "2026-01-01", None)]
    return spark.createDataFrame(rows, "collection string, retained_at string, original_directory string")


ARCHIVED = """, retained(collection, retained_at, original_directory) AS (
    VALUES ('src3', '2026-01-01', '/w/src3'), ('old', '2026-01-01', '/w/src3'), ('src4', '2026-01-01', '/elsewhere'), ('bare', '2026-01-01', NULL)
)"""
