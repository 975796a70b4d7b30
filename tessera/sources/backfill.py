"""Transcripts of sessions from JSONL files to chunks, capture files and totals."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.redact import Redaction, redact
from tessera.functions.vectors import Backend
from tessera.operators import chunking, transcripts
from tessera.sources.listing import list_tree

#: Where a registered directory keeps its capture files.
CAPTURES = "captures"


def read_transcripts(spark: SparkSession, root: str, budget: int = transcripts.MAX_CHARS) -> DataFrame:
    """(folder, session_id, modified, n_lines, text) of every ``root``/folder/session.jsonl, an empty file too.

    Lines are in the file's order, as the place of their block and their place in it tell; those that aren't messages
    are skipped. A text is the newest messages within ``budget`` characters. The listing
    (``list_tree``) reads no contents.
    """
    pattern = f"{root.rstrip('/')}/*/*.jsonl"
    path = F.regexp_replace(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), r"^[a-z]+:/*(?=/)", "")
    folder, session = (F.regexp_extract(path, r"([^/]+)/([^/]+)\.jsonl$", n) for n in (1, 2))
    listed = list_tree(spark, root, (), deepest=2).files.where(F.col("relative").rlike(r"^[^/]+/[^/]+\.jsonl$")).select(F.col("path").alias("file"), "modified")
    listed = listed.select(folder.alias("folder"), session.alias("session_id"), "modified")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), transcripts.message_text(F.col("value")).alias("entry"))
    lines = lines.select(F.struct(folder.alias("folder"), session.alias("session_id")).alias("session"), "place", "entry")
    read = transcripts.counted_texts(lines, "session", "place", budget=budget).select("session.*", "n_lines", "text")
    key = ["folder", "session_id"]
    return listed.join(read, key, "left").select(*key, "modified", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "text")


class Backfilled(NamedTuple):
    """outcomes: one row for each transcript that was visited; chunks to put in place of their documents; captures (path, content)
    to write; totals in one row.
    """

    outcomes: DataFrame
    chunks: DataFrame
    captures: DataFrame
    totals: DataFrame


def backfill(
    sessions: DataFrame,
    directories: DataFrame,
    documents: DataFrame,
    now: Column,
    scrub: Redaction | None = Redaction(),
    backend: Backend | None = None,
    limit: int = 0,
    errors: DataFrame | None = None,
) -> Backfilled:
    """What ``read_transcripts`` found, put into the captures collection of the directory that its folder stands for.

    Transcripts of unregistered folders, those whose document is among ``documents`` (collection, document_name) and empty
    ones are told and left; with a ``limit`` only so many are processed. A document is the artifacts' header and the text,
    redacted before it is chunked; its capture file, below the directory, has front matter and text, redacted as a whole.
    Write ``sessions`` before, since all four results come from it; only ``chunks`` and ``captures`` read its texts.
    """
    planned = transcripts.backfill_run(transcripts.backfill_plan(sessions, directories, documents), limit, errors)
    encoded = transcripts.encoded_directory(F.col("directory"))
    taken = planned.where(F.col("outcome") == "ingested").join(directories.select("directory", encoded.alias("folder")), "folder")
    found = transcripts.artifacts(F.col("text"))
    header = transcripts.artifact_header(found)
    body = F.when(header == "", F.col("text")).otherwise(F.concat(header, F.lit("\n\n"), F.col("text")))
    pages = chunking.inline_pages(taken.select("document_name", "collection", body.alias("content")), kind=F.lit("plain"))
    chunks = chunking.ingest(pages, now, backend, scrub)

    stamp = F.date_format(F.col("modified"), "yyyy-MM-dd'T'HH:mm:ss")
    front = transcripts.front_matter(found, F.col("session_id"), stamp)
    content = F.concat(front, F.lit("\n\n"), F.col("text"))
    name = F.concat_ws("/", F.regexp_replace("directory", "^/+", ""), F.lit(CAPTURES), F.concat("document_name", F.lit(".md")))
    captures = taken.where(front != "").select(name.alias("path"), (redact(content, scrub) if scrub else content).alias("content"))
    return Backfilled(planned.drop("text"), chunks, captures, transcripts.backfill_totals(planned, errors=errors is not None))
