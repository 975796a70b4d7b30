"""Queries of filtered, vector, worded and hybrid search, of chunking, and of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.vectors import HashingBackend, embed_query
from tessera.operators import catalog, chunking, retrieval
from tessera.operators.retrieval import SearchConfig, SearchFilter
from tessera.operators.scratch import scratch
from tessera.operators.vector_index import build_vector_index
from tessera.operators.word_index import WordIndex
from tessera.plans.tables import CHUNKS, DIRECTORIES, Registry, chunk_rows, registrations, table

registry = Registry()
KEY = ("document_name", "page_number", "chunk_index")
NOW = "2026-03-01 00:00:00"


def asked(spark: SparkSession, sf_dir: str) -> tuple[str, list[float]]:
    """The first benchmark item as the query text, and the first vector as the query's."""
    words = table(spark, sf_dir, "benchmark").where("item_id = 0").select("text").first()["text"]
    return words, table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()["embedding"]


def search_sql(k: int, fetch: int, where: str = "true", rate: float = 0.0) -> str:
    """CTEs near, worded (each with rank) and fused of one query."""
    weight = (
        f"CASE WHEN memory_type IN ('fact', 'observation', 'opinion', 'procedure') THEN exp(-{rate} * greatest(0.0,"
        f" (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ingestion_timestamp)) / 3.6e9)) ELSE 1.0 END"
        if rate
        else "1.0"
    )
    return f"""{CHUNKS}, asked AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0
), measured AS (
    SELECT c.*, CASE WHEN vector IS NULL THEN 2.0 ELSE 1 - list_dot_product(CAST(vector AS DOUBLE[]), q)
           / (sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))) * sqrt(list_dot_product(q, q))) END AS distance
    FROM chunks c, asked
), tokens AS (
    SELECT document_name, page_number, chunk_index, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS words FROM chunks
), stats AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM tokens
), postings AS (
    SELECT document_name, page_number, chunk_index, len(words) AS length, term, count(*) AS tf
    FROM tokens, unnest(words) AS u(term) GROUP BY ALL
), terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark WHERE item_id = 0
), df AS (SELECT term, count(*) AS df FROM postings JOIN terms USING (term) GROUP BY term
), scores AS (
    SELECT document_name, page_number, chunk_index,
           round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))), 9) AS score
    FROM postings JOIN df USING (term), stats GROUP BY ALL
), near AS (
    SELECT *, row_number() OVER (ORDER BY distance, document_name, page_number, chunk_index) - 1 AS rank FROM measured WHERE {where}
    QUALIFY rank < {fetch}
), worded AS (
    SELECT m.*, score, row_number() OVER (ORDER BY score DESC, document_name, page_number, chunk_index) - 1 AS rank
    FROM measured m JOIN scores USING (document_name, page_number, chunk_index) WHERE {where}
    QUALIFY rank < {fetch}
), both_ AS (
    SELECT document_name, chunk_index, page_number, {weight} / (60.0 + rank) AS term, rank AS seen FROM near
    UNION ALL SELECT document_name, chunk_index, page_number, {weight} / (60.0 + rank), 1000000000 + rank FROM worded
), fused AS (
    SELECT document_name, chunk_index, page_number, round(sum(term), 12) AS rrf, min(seen) AS seen FROM both_ GROUP BY ALL
    ORDER BY rrf DESC, seen LIMIT {k}
)"""


HITS = """
SELECT document_name, collection, page_number, chunk_index, text, page_type, source_format, agent_handle, memory_type, summary,
       round(1 - distance, 4) AS similarity
FROM fused JOIN measured USING (document_name, page_number, chunk_index)"""


@registry.add(f"{CHUNKS} SELECT collection, document_name, page_number, chunk_index FROM chunks WHERE collection = 'src1' AND page_type = 'text' AND agent_handle = 'agent-1'")
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F5, P1."""
    where = SearchFilter(collection="src1", page_type="text", agent_handle="agent-1", memory_type="")
    return chunk_rows(spark, sf_dir).where(where.predicate()).select("collection", *KEY)


@registry.add(f"{CHUNKS} SELECT collection, document_name, page_number, chunk_index FROM chunks WHERE document_name = 'doc-7' AND chunk_index >= 2")
def document_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4."""
    return chunk_rows(spark, sf_dir).where(retrieval.document_selector("doc-7", from_chunk=2)).select("collection", *KEY)


@registry.add(search_sql(20, 20) + " SELECT document_name, page_number, chunk_index, round(1 - distance, 4) AS similarity FROM near")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2, R3, R11, P3."""
    _, vector = asked(spark, sf_dir)
    found = retrieval.vector_top_k(chunk_rows(spark, sf_dir), vector, 20)
    return found.select(*KEY, retrieval.similarity(F.col("distance")).alias("similarity"))


@registry.add(search_sql(20, 20, "memory_type = 'fact'") + " SELECT document_name, page_number, chunk_index, round(1 - distance, 4) AS similarity FROM near")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, F3."""
    _, vector = asked(spark, sf_dir)
    found = retrieval.vector_top_k(chunk_rows(spark, sf_dir), vector, 20, SearchFilter(memory_type="fact"))
    return found.select(*KEY, retrieval.similarity(F.col("distance")).alias("similarity"))


@registry.add(search_sql(30, 30) + " SELECT document_name, page_number, chunk_index, score FROM worded")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4, K3."""
    words, _ = asked(spark, sf_dir)
    return retrieval.bm25_top_k(chunk_rows(spark, sf_dir), words, 30).select(*KEY, "score")


@registry.add(search_sql(30, 30, "page_type = 'code'") + " SELECT document_name, page_number, chunk_index, score FROM worded")
def bm25_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter holds for candidates, not for statistics."""
    words, _ = asked(spark, sf_dir)
    return retrieval.bm25_top_k(chunk_rows(spark, sf_dir), words, 30, SearchFilter(page_type="code")).select(*KEY, "score")


@registry.add(
    search_sql(1, 1)
    + " SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df, CAST(sum(length) AS BIGINT) AS lengths FROM postings GROUP BY term"
)
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index, added up by term."""
    terms, _ = retrieval.postings(chunk_rows(spark, sf_dir))
    return terms.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"), F.sum("length").alias("lengths"))


@registry.add(search_sql(20, 20) + " SELECT document_name, page_number, chunk_index, round(1 - distance, 4) AS similarity FROM near")
def vector_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vector_topk`` by an index of all rows, all of whose cells are read."""
    _, vector = asked(spark, sf_dir)
    index = build_vector_index(chunk_rows(spark, sf_dir), scratch(spark, "vector-index"))
    found = index.search(vector, 20, exact_search=True)
    return found.select(*KEY, retrieval.similarity(F.col("distance")).alias("similarity"))


def changed_words(spark: SparkSession, sf_dir: str) -> WordIndex:
    """Stored postings of all rows: a first segment in which every fourth document has another text, then one with its own
    text that replaces it.
    """
    rows = chunk_rows(spark, sf_dir)
    own = F.pmod(F.xxhash64("collection", "document_name"), F.lit(4)) == 0
    index = WordIndex(spark, scratch(spark, "word-index"))
    index.add(rows.withColumn("text", F.when(own, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))))
    changed = rows.where(own)
    index.add(changed, changed.select("collection", "document_name"))
    return index


@registry.add(search_sql(30, 30) + " SELECT document_name, page_number, chunk_index, score FROM worded")
def bm25_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bm25_topk`` by stored postings, of which a part was replaced, with blocks that are skipped by their bounds."""
    words, _ = asked(spark, sf_dir)
    return changed_words(spark, sf_dir).top_k(words, 30).hits


@registry.add(search_sql(30, 30, "page_type = 'code'") + " SELECT document_name, page_number, chunk_index, score FROM worded")
def bm25_topk_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bm25_topk_filtered`` by the segments merged into one."""
    words, _ = asked(spark, sf_dir)
    index = changed_words(spark, sf_dir)
    index.merge()
    return index.top_k(words, 30, SearchFilter(page_type="code")).hits


@registry.add(search_sql(10, 30) + HITS)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R14, J1, J16, W1, A9, K4, R5, R6, P2, P6."""
    words, vector = asked(spark, sf_dir)
    return retrieval.hybrid_search(chunk_rows(spark, sf_dir), words, vector, 10, F.lit(NOW).cast("timestamp"))


@registry.add(search_sql(10, 30, "collection IN ('src2') AND page_type = 'text'", 0.01) + HITS)
def hybrid_search_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that decay, under a filter."""
    words, vector = asked(spark, sf_dir)
    where = SearchFilter(collection="src2", page_type="text")
    return retrieval.hybrid_search(chunk_rows(spark, sf_dir), words, vector, 10, F.lit(NOW).cast("timestamp"), where, SearchConfig(decay_rate=0.01))


@registry.add(
    search_sql(10, 30)
    + """ SELECT document_name, page_number, chunk_index, round(1 - distance, 4) AS similarity FROM near WHERE rank < 10"""
)
def vector_only_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an index the vector channel answers alone."""
    words, vector = asked(spark, sf_dir)
    hits = retrieval.hybrid_search(chunk_rows(spark, sf_dir), words, vector, 10, F.lit(NOW).cast("timestamp"), index=False)
    return hits.select(*KEY, "similarity")


BATCH = r"""
, queries AS (
    SELECT item_id AS query_id, text AS words, CAST(embedding AS DOUBLE[]) AS q FROM benchmark JOIN embeddings ON vec_id = item_id
), tokens AS (SELECT document_name, page_number, chunk_index, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM chunks
), stats AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM tokens
), postings AS (
    SELECT document_name, page_number, chunk_index, len(words) AS length, term, count(*) AS tf FROM tokens, unnest(words) AS u(term) GROUP BY ALL
), terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(words), '[\p{L}\p{N}]+')) AS term FROM queries
), df AS (SELECT term, count(*) AS df FROM postings WHERE term IN (SELECT term FROM terms) GROUP BY term
), scores AS (
    SELECT query_id, document_name, page_number, chunk_index,
           round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))), 9) AS score
    FROM terms JOIN postings USING (term) JOIN df USING (term), stats GROUP BY ALL
), near AS (
    SELECT query_id, document_name, page_number, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY
           CASE WHEN vector IS NULL THEN 2.0 ELSE 1 - list_dot_product(CAST(vector AS DOUBLE[]), q)
             / (sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))) * sqrt(list_dot_product(q, q))) END,
           document_name, page_number, chunk_index) - 1 AS rank
    FROM chunks, queries QUALIFY rank < 30
), worded AS (
    SELECT query_id, document_name, page_number, chunk_index,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_name, page_number, chunk_index) - 1 AS rank
    FROM scores QUALIFY rank < 30
), fused AS (
    SELECT query_id, document_name, chunk_index, page_number, round(sum(1.0 / (60.0 + rank)), 12) AS rrf, min(seen) AS seen
    FROM (SELECT *, rank AS seen FROM near UNION ALL SELECT *, 1000000000 + rank FROM worded) GROUP BY ALL
)
SELECT query_id, document_name, page_number, chunk_index, rrf,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen) - 1 AS INTEGER) AS position
FROM fused QUALIFY position < 10"""


def batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items that have a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(vectors, "query_id")


@registry.add(CHUNKS + BATCH)
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R14 for all benchmark items that have a vector, 64 at a time."""
    found = retrieval.batch_search(chunk_rows(spark, sf_dir), batch_queries(spark, sf_dir), 10, block=64)
    return found.select("query_id", *KEY, "rrf", "position")


@registry.add(CHUNKS + BATCH)
def batch_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch_search`` in smaller blocks."""
    found = retrieval.batch_search(chunk_rows(spark, sf_dir), batch_queries(spark, sf_dir), 10, block=16)
    return found.select("query_id", *KEY, "rrf", "position")


PACKED = r"""
WITH sentences AS (
    SELECT doc_id, trim(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS whole FROM documents
), packed AS (
    SELECT doc_id, CASE WHEN length(whole) = 0 THEN [] WHEN length(whole) <= 1800 THEN [whole] ELSE (
        list_reduce([{'done': CAST([] AS VARCHAR[]), 'open': CAST(NULL AS VARCHAR), 'size': CAST(0 AS BIGINT)}] || list_transform(
            string_split(regexp_replace(whole, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
            lambda s: {'done': CAST([] AS VARCHAR[]), 'open': s, 'size': length(s)}),
            lambda a, s: CASE
                WHEN a.open IS NULL OR a.size + s.size <= 1800
                  THEN {'done': a.done, 'open': CASE WHEN a.open IS NULL THEN s.open ELSE a.open || ' ' || s.open END, 'size': a.size + s.size + 1}
                WHEN length(a.open) <= 200 THEN {'done': a.done || [a.open], 'open': s.open, 'size': s.size + 1}
                ELSE {'done': a.done || [a.open],
                      'open': (CASE WHEN strpos(right(a.open, 200), ' ') > 0 THEN substr(right(a.open, 200), strpos(right(a.open, 200), ' ') + 1)
                               ELSE right(a.open, 200) END) || ' ' || s.open,
                      'size': length(CASE WHEN strpos(right(a.open, 200), ' ') > 0 THEN substr(right(a.open, 200), strpos(right(a.open, 200), ' ') + 1)
                               ELSE right(a.open, 200) END) + s.size + 1} END)) END AS last, whole
    FROM sentences
)"""

CHUNKED = PACKED.replace(
    "CASE WHEN length(whole) = 0 THEN [] WHEN length(whole) <= 1800 THEN [whole] ELSE (", "CASE WHEN length(whole) > 1800 THEN ("
) + """, chunked AS (
    SELECT doc_id, CASE WHEN length(whole) = 0 THEN CAST([] AS VARCHAR[]) WHEN length(whole) <= 1800 THEN [whole]
           ELSE last.done || [last.open] END AS parts FROM packed
), rows_ AS (SELECT doc_id, unnest(parts) AS text, unnest(range(len(parts))) AS chunk_index FROM chunked)
SELECT 'd' || doc_id AS document_name, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(length(text) AS INTEGER) AS n, md5(text) AS digest FROM rows_"""


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one page."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_name"), F.col("source").alias("collection"), F.lit(1).alias("page_number"),
        F.lit(1).alias("total_pages"), "text", F.lit("section").alias("page_type"),
    )


@registry.add(CHUNKED)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7, W2, F10."""
    made = chunking.chunk_pages(document_pages(spark, sf_dir), F.lit(NOW))
    return made.select("document_name", "chunk_index", F.length("text").alias("n"), F.md5("text").alias("digest"))


@registry.add()
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted, chunked and embedded rows of the whole schema. Vectors are no SQL; tested by value."""
    from tessera.functions.redact import Redaction

    return chunking.ingest(document_pages(spark, sf_dir), F.lit(NOW), HashingBackend(), Redaction())


@registry.add()
def hashed_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, embedded, searched by a text. Tested against its parts."""
    words, _ = asked(spark, sf_dir)
    backend = HashingBackend()
    made = retrieval.stored(chunking.ingest(document_pages(spark, sf_dir), F.lit(NOW), backend).drop("page_raw_text"))
    return retrieval.hybrid_search(made, words, embed_query(words, backend), 10, F.lit(NOW).cast("timestamp"))


@registry.add(r"""
WITH named AS (SELECT doc_id, '# A' || chr(10) || text || chr(10) || chr(10) || '## B' || chr(10) || doc_id AS whole FROM documents)
SELECT 'd' || doc_id AS document_name, CAST(n AS INTEGER) AS page_number, CAST(2 AS INTEGER) AS total_pages, 'section' AS page_type,
       md5(CASE n WHEN 1 THEN '# A' || chr(10) || substr(whole, 5, length(whole) - 4 - length('## B' || chr(10) || doc_id)) ELSE '## B' || chr(10) || doc_id END) AS digest
FROM named, (VALUES (1), (2)) v(n)""")
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under two headings, split by them."""
    whole = F.concat(F.lit("# A\n"), "text", F.lit("\n\n## B\n"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_name"), whole.alias("content"))
    return chunking.inline_pages(docs).select("document_name", "page_number", "total_pages", "page_type", F.md5("text").alias("digest"))


@registry.add(r"""
SELECT 'd' || doc_id AS document_name, CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'latex' ELSE 'plain' END AS format,
       CAST(CASE doc_id % 3 WHEN 0 THEN 1 ELSE 2 END AS INTEGER) AS sections
FROM documents WHERE length(trim(text)) > 0""")
def format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading in front, two LaTeX sections, or two paragraphs."""
    at = F.col("doc_id") % 3
    flat = F.regexp_replace("text", r"[\s#\\]+", " ")
    whole = F.when(at == 0, F.concat(F.lit("# T\n"), flat)).when(at == 1, F.concat(F.lit("\\section{A}\n"), flat, F.lit("\n\\subsection{B} x"))).otherwise(F.concat(flat, F.lit("\n \nend")))
    docs = table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0)
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_name"), tx.detect_format(whole).alias("format"), F.size(tx.sections(whole, F.lit("auto"))).alias("sections")
    )


@registry.add(r"""
WITH flat AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE rtrim(substr(t, 1, 157)) || '...' END AS excerpt FROM flat""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@registry.add(f"""{CHUNKS}, firsts AS (
    SELECT *, row_number() OVER (PARTITION BY document_name ORDER BY page_number, chunk_index, collection) AS n FROM chunks
), counted AS (
    SELECT document_name, count(*) AS chunk_count, count(DISTINCT page_number) AS indexed_pages, CAST(max(ingestion_timestamp) AS VARCHAR) AS ingestion_timestamp
    FROM chunks GROUP BY document_name
)
SELECT document_name, document_path, collection, total_pages, chunk_count, indexed_pages, c.ingestion_timestamp
FROM counted c JOIN (SELECT document_name, document_path, collection, total_pages FROM firsts WHERE n = 1) USING (document_name)""")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, S1."""
    return catalog.list_documents(chunk_rows(spark, sf_dir))


@registry.add(f"{CHUNKS} SELECT collection, count(DISTINCT document_name) AS document_count, count(*) AS chunk_count FROM chunks GROUP BY collection")
def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, K6, X7."""
    return catalog.list_collections(chunk_rows(spark, sf_dir))


@registry.add(f"{CHUNKS} SELECT count(*) AS chunk_count FROM chunks WHERE collection = 'src2'")
def count_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return catalog.count_chunks(chunk_rows(spark, sf_dir), "src2")


@registry.add(f"""{CHUNKS}, counted AS (SELECT collection, count(DISTINCT document_name) AS d, count(*) AS c FROM chunks GROUP BY collection),
{DIRECTORIES.strip().removeprefix("WITH ")}
SELECT CAST(sum(d) AS BIGINT) AS document_count, count(*) AS collection_count, CAST(sum(c) AS BIGINT) AS chunk_count,
       (SELECT count(*) FROM directories) AS registered_directories FROM counted""")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return catalog.status(chunk_rows(spark, sf_dir), registrations(spark, sf_dir))


@registry.add(f"{CHUNKS} SELECT count(DISTINCT document_name) AS document_count FROM chunks")
def database_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return catalog.database_documents(chunk_rows(spark, sf_dir))


@registry.add(f"{CHUNKS} SELECT page_raw_text FROM chunks WHERE document_name = 'doc-3' AND page_number = 2 ORDER BY collection, chunk_index LIMIT 1")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12, R13, J17."""
    return catalog.show(chunk_rows(spark, sf_dir), "doc-3", 2)


@registry.add(f"""{CHUNKS} SELECT document_name, min_by(collection, page_number * 10 + chunk_index) AS collection, count(*) AS chunk_count
FROM chunks WHERE document_name = 'doc-3' GROUP BY document_name""")
def show_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R13 without a page."""
    return catalog.show(chunk_rows(spark, sf_dir), "doc-3").select("document_name", "collection", "chunk_count")


@registry.add("""
WITH pages AS (SELECT source, count(*) AS total_pages, count(*) FILTER (WHERE doc_id % 3 = 0) AS t, count(*) FILTER (WHERE doc_id % 3 = 1) AS i,
               count(*) FILTER (WHERE doc_id % 3 = 2) AS s, bool_and(doc_id % 3 <> 1) AS deterministic FROM documents GROUP BY source)
SELECT source AS document_name, total_pages, t AS text_pages, i AS image_pages, s AS sections, deterministic FROM pages WHERE source IS NOT NULL""")
def page_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by class, and whether none came from character recognition."""
    at = F.col("doc_id") % 3
    kind = F.when(at == 0, "text").when(at == 1, "image").otherwise("section")
    pages = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("document_name"), kind.alias("page_type"))
    rows = chunking.ingest_summary(pages, pages.select("document_name", F.col("document_name").alias("collection")))
    told = F.from_json("summary", "total_pages long, text_pages long, image_pages long, sections long")
    counts = [F.coalesce(told[c], F.lit(0)).alias(c) for c in ("total_pages", "text_pages", "image_pages", "sections")]
    return rows.select("document_name", *counts).join(chunking.is_deterministic(pages), "document_name")
