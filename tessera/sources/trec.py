"""Runs and judgments of retrieval evaluation as text, and query sets as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS, SPLITS = ("natural", "known-item", "regression"), ("dev", "test")
QUERY = "id string, text string, bucket string, split string, answer struct<document_name:string,page_number:int>"


def format_run(run: DataFrame, tag: str) -> DataFrame:
    """S24: 'qid Q0 docid rank score tag' lines of (query_id, docid, rank, score), as column value; write with ``write.text``."""
    return run.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), "docid", F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(tag)).alias("value"))


def parse_run(lines: DataFrame) -> DataFrame:
    """Lines (column value) as (query_id, docid, rank, score, tag); a line of another form is an error."""
    parts = F.split(F.trim("value"), r"\s+")
    bad = F.size(parts) != 6
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no run line: "), F.col("value"))).cast("string")).otherwise(parts[0])
    rows = lines.where(F.trim("value") != "")
    return rows.select(checked.alias("query_id"), parts[2].alias("docid"), parts[3].cast("int").alias("rank"), parts[4].cast("double").alias("score"), parts[5].alias("tag"))


def format_qrels(qrels: DataFrame) -> DataFrame:
    """S24: 'qid 0 docid rel' lines."""
    return qrels.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("0"), "docid", F.col("rel").cast("string")).alias("value"))


def parse_qrels(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(parts) == 4).select(parts[0].alias("query_id"), parts[2].alias("docid"), parts[3].cast("int").alias("rel"))


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines query set. A bucket, split or id that is unknown, missing or given twice is an error when it is read."""
    rows = spark.read.schema(QUERY).json(path)
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    fine = F.col("bucket").isin(*BUCKETS) & F.col("split").isin(*SPLITS) & F.col("id").isNotNull() & (F.col("_n") == 1)
    said = F.concat(F.lit("bad query: "), F.coalesce("id", F.lit("without id")))
    checked = F.when(F.coalesce(fine, F.lit(False)), F.col("id")).otherwise(F.raise_error(said).cast("string"))
    return rows.withColumn("_n", n).select(checked.alias("query_id"), "text", "bucket", "split", "answer")
