"""A stream's micro-batches put into the chunk table once each, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.store import ChunkStore


def flush_parts(rows: DataFrame, flush_bytes: int, most: int = 1024) -> int:
    """Into how many parts ``rows`` are cut, so that one has about ``flush_bytes`` of texts and vectors; one at least."""
    if flush_bytes <= 0:
        raise ValueError("flush_bytes must be positive")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + (F.coalesce(F.greatest(F.size("vector"), F.lit(0)), F.lit(0)) * 4 if "vector" in rows.columns else 0)
    total = rows.agg(F.sum(size)).first()[0] or 0
    return max(1, min(most, -(-int(total) // flush_bytes)))


def watermarks_of(rows: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(path, collection, document_name, chunks_committed, complete) of chunks that have a ``path``; ``totals`` (path,
    total_chunks) says how many a document has in all, by default those that are there.
    """
    marks = rows.groupBy("path", "collection", "document_name").agg(F.count(F.lit(1)).cast("int").alias("chunks_committed"))
    if totals is None:
        return marks.withColumn("complete", F.lit(True))
    whole = totals.select("path", "total_chunks")
    return marks.join(whole, "path", "left").withColumn("complete", F.coalesce(F.col("chunks_committed") >= F.col("total_chunks"), F.lit(True))).drop("total_chunks")


def chunk_sink(
    store: ChunkStore,
    stream: str,
    ingest: Callable[[DataFrame], DataFrame],
    flush_bytes: int = 64 << 20,
    admit: Callable[[DataFrame], DataFrame] = lambda batch: batch,
) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that puts what ``ingest`` makes of a batch into ``store`` exactly once.

    ``admit`` keeps the rows of files that may come in; ``ingest`` gives chunks with a ``path``. A batch of more than
    ``flush_bytes`` is flushed in parts, whole documents to each by a hash of the path, and every part is a snapshot of
    its own with its chunks, its watermarks and its number. A batch that comes again, since its stream ended before it
    was through, has the same rows, so the same parts; those that are in are left out and the others follow. How much comes
    in one batch is for the source to bound (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
    """

    def flush(batch: DataFrame, number: int) -> None:
        chunks = ingest(admit(batch)).persist()
        try:
            parts = flush_parts(chunks, flush_bytes)
            place = F.pmod(F.xxhash64("path"), F.lit(parts))
            for part in range(parts):
                own = chunks.where(place == part) if parts > 1 else chunks
                store.append_batch(own, stream, number, part, watermarks=watermarks_of(own))
        finally:
            chunks.unpersist()

    return flush
