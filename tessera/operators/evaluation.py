"""Offline retrieval evaluation: collapse to judged units, and reciprocal-rank metrics by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import docid, is_structural


def qrels_of(queries: DataFrame) -> DataFrame:
    """Judgments of a query set: one for each query that has an answer."""
    answered = queries.where(F.col("answer.document_name").isNotNull())
    return answered.select("query_id", docid(F.col("answer.document_name"), F.col("answer.page_number")).alias("docid"), F.lit(1).alias("rel"))


def collapse(hits: DataFrame, page_level: bool = False) -> DataFrame:
    """(query_id, docid, position, score) from hits with ``position`` (0, 1, ...): the best position of each
    unit, gaps kept, score 1 / (position + 1).
    """
    unit = docid(F.col("document_name"), F.col("page_number") if page_level else None)
    best = hits.select("query_id", unit.alias("docid"), "position").groupBy("query_id", "docid").agg(F.min("position").alias("position"))
    return best.withColumn("score", 1.0 / (F.col("position") + 1))


def trec_rank(run: DataFrame) -> DataFrame:
    """Ranks from 1 within a query, by score, then docid."""
    return run.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "docid")))


def pollution(hits: DataFrame, k: int = 10) -> DataFrame:
    """share of structural chunks among the first ``k`` of each query."""
    return hits.where(F.col("position") < k).groupBy("query_id").agg(F.avg(is_structural(F.col("text")).cast("double")).alias("pollution"))


def metrics(queries: DataFrame, run: DataFrame, qrels: DataFrame, polluted: DataFrame | None = None) -> DataFrame:
    """Per bucket and overall ('all'): queries, scorable ones, MRR, success at 5 and 10, judged and pollution at 10.

    A scorable query that found nothing scores 0; a bucket without scorable queries has null metrics. Ranks are 1, 2, ...
    of the collapsed run, without its gaps.
    """
    ranked = trec_rank(run)
    judged = qrels.select("query_id", "docid", "rel")
    seen = ranked.join(judged, ["query_id", "docid"], "left")
    per = seen.groupBy("query_id").agg(
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"),
        F.avg(F.when(F.col("rank") <= 10, F.col("rel").isNotNull().cast("double"))).alias("judged"),
    )
    scorable = judged.select("query_id").distinct().withColumn("scorable", F.lit(True))
    rows = queries.select("query_id", "bucket").join(scorable, "query_id", "left").join(per, "query_id", "left")
    rows = rows.join(polluted, "query_id", "left") if polluted is not None else rows.withColumn("pollution", F.lit(None).cast("double"))
    hit = lambda k: F.when(F.col("scorable"), F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)))
    rows = rows.select(
        "bucket",
        F.col("scorable").isNotNull().alias("scorable"),
        F.when(F.col("scorable"), F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("rr"),
        hit(5).alias("hit5"),
        hit(10).alias("hit10"),
        F.when(F.col("scorable"), F.coalesce("judged", F.lit(0.0))).alias("judged"),
        "pollution",
    )
    return (
        rows.rollup("bucket")
        .agg(
            F.grouping("bucket").alias("overall"),
            F.count(F.lit(1)).alias("n_queries"),
            F.count_if("scorable").alias("n_scorable"),
            F.round(F.avg("rr"), 9).alias("mrr"),
            F.round(F.avg("hit5"), 9).alias("success_at_5"),
            F.round(F.avg("hit10"), 9).alias("success_at_10"),
            F.round(F.avg("judged"), 9).alias("judged_at_10"),
            F.round(F.coalesce(F.avg("pollution"), F.lit(0.0)), 9).alias("pollution_at_10"),
        )
        .withColumn("bucket", F.when(F.col("overall") == 1, F.lit("all")).otherwise(F.col("bucket")))
        .drop("overall")
    )


def corpus_signature(files: DataFrame) -> DataFrame:
    """16 hex digits that change with any name or content: (name, content) hashed per file, then over all by name.

    Only digests are gathered, 64 bytes for each file of an evaluation corpus.
    """
    one = files.select(F.struct("name", F.sha2(F.col("content").cast("binary"), 256).alias("digest")).alias("f"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda f: F.concat_ws("\0", f["name"], f["digest"])), "\n")
    return one.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("signature"))
