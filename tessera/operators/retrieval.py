"""Filtered hybrid search: exact cosine top-k and BM25 top-k, fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.tokens import batch_best, counted_terms
from tessera.functions.vectors import NO_DISTANCE, batch_top_k, cosine_distance, distance, similarity
from tessera.operators.scratch import scratch

KEY = ("document_name", "page_number", "chunk_index")
#: BM25 over tokens of letters and digits, without stemming or stop words.
TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
#: Memory types whose score decays with age.
DECAYING = ("fact", "observation", "opinion", "procedure")


@dataclass(frozen=True)
class SearchFilter:
    """equality predicates; an empty string or None is no predicate."""

    collection: str | None = None
    document_name: str | None = None
    page_type: str | None = None
    source_format: str | None = None
    agent_handle: str | None = None
    memory_type: str | None = None

    def predicate(self) -> Column:
        asked = [F.col(name) == F.lit(value) for name, value in vars(self).items() if value]
        return reduce(lambda a, b: a & b, asked, F.lit(True))


@dataclass(frozen=True)
class SearchConfig:
    """R8. ``rerank`` is R9: a function over the fused hits. ``exact_search`` compares all vectors even where an index is given;
    ``metric`` must be the index's; ``embedding_strategy`` names how the query's vector was made, and is told to ``rerank`` only.
    """

    rrf_k: int = 60
    fetch_multiplier: int = 3
    decay_rate: float = 0.0
    metric: str = "cosine"
    exact_search: bool = False
    embedding_strategy: str = "baseline"
    rerank: Callable[[DataFrame], DataFrame] = field(default=lambda hits: hits)


def document_selector(document_name: str, collection: str | None = None, from_chunk: int | None = None) -> Column:
    """a document, in one collection if named, from a chunk on if given."""
    predicate = F.col("document_name") == F.lit(document_name)
    if collection is not None:
        predicate &= F.col("collection") == F.lit(collection)
    if from_chunk is not None:
        predicate &= F.col("chunk_index") >= F.lit(from_chunk)
    return predicate


def clamp_limit(value: object, default: int = 10, most: int = 50) -> int:
    """F6, as the HTTP route has it."""
    try:
        return max(1, min(int(value), most))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default


def strict_limit(value: int, most: int = 50) -> int:
    """F6, as the tool server has it: not positive is an error."""
    if value <= 0:
        raise ValueError("limit must be positive")
    return min(value, most)


def vector_top_k(
    chunks: DataFrame, query: list[float], k: int, where: SearchFilter = SearchFilter(), key: tuple[str, ...] = KEY, metric: str = "cosine"
) -> DataFrame:
    """The ``k`` nearest rows, exactly; ties by key. Filter, distance and limit are one pass: each task keeps k."""
    return chunks.where(where.predicate()).withColumn("distance", distance(F.col("vector"), query, metric)).orderBy("distance", *key).limit(k)


def postings(chunks: DataFrame, key: tuple[str, ...] = KEY, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(term, key, tf, length) of all rows, and (n, avgdl) as one row; of the terms ``only``, if some are named. A row's tokens are
    counted where the row is, so nothing is shuffled. Store the first by term for repeated use.
    """
    rows = _tokenized(chunks, key)
    return _posted(counted_terms(_wanted(rows, only)), key), rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avgdl"))


def _tokenized(chunks: DataFrame, key: tuple[str, ...]) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    return chunks.select(*key, tokens.alias("tokens")).withColumn("length", F.size("tokens"))


def _wanted(rows: DataFrame, only: list[str] | None) -> DataFrame:
    return rows if only is None else rows.withColumn("tokens", F.filter("tokens", lambda t: t.isin(only)))


def _posted(counted: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return counted.select(*key, "length", F.explode("terms").alias("t")).select(*key, "length", "t.term", F.col("t.tf").cast("long").alias("tf"))


def _statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avgdl"))


def stored_terms(chunks: DataFrame, key: tuple[str, ...] = KEY, only: list[str] | None = None) -> DataFrame:
    """(key, length, terms) of texts that are read and tokenized once: each row's counts, of the terms ``only`` if some are
    named, are written to the shared folder, and are read from there however often they are asked for.
    """
    return stored(counted_terms(_wanted(_tokenized(chunks, key), only)), "terms")


def stored(rows: DataFrame, name: str = "rows") -> DataFrame:
    """``rows`` written to the shared folder and read from there, for rows that take long to make and are read several times."""
    folder = scratch(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def stored_once(chunks: DataFrame, key: tuple[str, ...] = KEY, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``postings`` of ``stored_terms``."""
    rows = stored_terms(chunks, key, only)
    return _posted(rows, key), _statistics(rows)


def query_terms(query: str) -> list[str]:
    import regex

    return list(dict.fromkeys(regex.findall(TOKEN, query.lower())))


def bm25_scores(terms: DataFrame, stats: DataFrame, query: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, score) of every row that has a query term; statistics are those of the whole table, a row that both sides
    of one broadcast carry. The scan of the terms is a pushed-down filter.
    """
    wanted = terms.where(F.col("term").isin(query_terms(query)))
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    # df has a row for each query term, stats one row.
    weighed = wanted.join(F.broadcast(df.join(F.broadcast(stats), F.lit(True), "inner")), "term")
    return weighed.groupBy(*key).agg(F.round(F.sum(part), 9).alias("score"))


def bm25_top_k(
    chunks: DataFrame, query: str, k: int, where: SearchFilter = SearchFilter(), index: tuple[DataFrame, DataFrame] | None = None, key: tuple[str, ...] = KEY
) -> DataFrame:
    """K3: the ``k`` best rows by BM25 among those that pass the filter. Best first, ties by key.

    Without an index texts are tokenized once, and the postings, of the query's terms alone, are stored on the way.

    Keys alone meet the scores; only the ``k`` best, which bounds the broadcast, are then looked up, so no text or
    vector is shuffled.
    """
    scores = bm25_scores(*(index or stored_once(chunks, key, query_terms(query))), query, key)
    kept = chunks.where(where.predicate())
    best = _told(scores.join(kept.select(*key), list(key), "left_semi").orderBy(F.desc("score"), *key).limit(k))
    return rows_of(kept, best, key).join(F.broadcast(best), list(key)).orderBy(F.desc("score"), *key).limit(k)


def _told(best: DataFrame) -> DataFrame:
    """A top-k as rows that the driver holds, so that it is not made again where it is used again."""
    return best.sparkSession.createDataFrame(best.collect(), best.schema)


def rows_of(chunks: DataFrame, best: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows of ``chunks`` with a key of ``best``, a top-k, null keys too. The documents' names are a filter, which Spark takes down
    to the scan, below the joins that ``chunks`` is made by: other documents' texts don't get to those.
    """
    names = [r[0] for r in best.select(key[0]).distinct().collect()]
    kept = F.col(key[0]).isin([n for n in names if n is not None])
    if None in names:
        kept |= F.col(key[0]).isNull()
    wanted = best.select(*[F.col(c).alias(f"_{c}") for c in key])
    return chunks.where(kept).join(F.broadcast(wanted), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]), "left_semi")


def _nearest(chunks: DataFrame, query: list[float], k: int, where: SearchFilter, metric: str) -> DataFrame:
    """``vector_top_k`` for whole rows: keys and distances are ranked first, and what has one of the best keys once more."""
    best = _told(vector_top_k(chunks, query, k, where, metric=metric).select(*KEY))
    return vector_top_k(rows_of(chunks, best), query, k, where, metric=metric)


class VectorChannel(Protocol):
    """What ``hybrid_search`` asks of an index of vectors."""

    def search(self, query: list[float], k: int, where: SearchFilter = SearchFilter(), *, metric: str = "cosine") -> DataFrame: ...


def looked_up(chunks: DataFrame, found: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows of ``chunks`` whose keys are in ``found``, a top-k, with its other columns; what is gone from ``chunks`` is no hit."""
    return chunks.join(F.broadcast(found), list(key))


def decay_weight(memory_type: Column, timestamp: Column, now: Column, rate: float) -> Column:
    """exp(-rate x hours) for memories that decay; 1 for others, for a rate of 0 and for unreadable times."""
    if rate <= 0:
        return F.lit(1.0)
    at = F.try_to_timestamp(timestamp.cast("string"))
    hours = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / 3.6e9)
    return F.when(memory_type.isin(*DECAYING), F.coalesce(F.exp(-rate * hours), F.lit(1.0))).otherwise(F.lit(1.0))


def fuse(channels: list[DataFrame], k: int, rrf_k: int = 60, weight: Column | None = None, group: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of ranked channels, which have ``rank`` from 0.

    Hits meet on document, chunk and page, not on collection; a term is weight / (rrf_k + rank); the row first seen
    (earlier channel, then better rank) gives the columns and breaks ties. ``group`` fuses many queries at once.
    """
    key = [*group, "document_name", "chunk_index", "page_number"]
    weight = weight if weight is not None else F.lit(1.0)
    rows = [
        c.withColumn("term", weight / (F.lit(float(rrf_k)) + F.col("rank"))).withColumn("seen", F.lit(n * 1_000_000_000).cast("long") + F.col("rank"))
        for n, c in enumerate(channels)
    ]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    rest = [c for c in both.columns if c not in (*key, "term", "seen", "rank")]
    fused = both.groupBy(*key).agg(F.round(F.sum("term"), 12).alias("rrf"), F.min("seen").alias("seen"), F.min_by(F.struct(*rest), "seen").alias("row"))
    fused = fused.select(*key, "rrf", "seen", *[F.col(f"row.{c}").alias(c) for c in rest])
    if group:
        order = Window.partitionBy(*group).orderBy(F.desc("rrf"), "seen")
        return fused.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < k)
    return fused.orderBy(F.desc("rrf"), "seen").limit(k)


def ranked(hits: DataFrame, order: list[Column]) -> DataFrame:
    """``rank`` from 0 over a limited channel (so the one window partition has that many rows)."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def hit_columns(hits: DataFrame) -> DataFrame:
    """The columns of a search hit, nulls coerced, similarity for distance."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    count = lambda c: F.coalesce(F.col(c).cast("double").cast("int"), F.lit(0)).alias(c)
    return hits.select(
        text("document_name"), text("collection"), count("page_number"), count("chunk_index"), text("text"), text("page_type"),
        text("source_format"), text("agent_handle"), text("memory_type"), text("summary"),
        similarity(F.coalesce(F.col("distance"), F.lit(NO_DISTANCE))).alias("similarity"),
    )


def hybrid_search(
    chunks: DataFrame,
    query: str,
    vector: list[float],
    k: int,
    now: Column,
    where: SearchFilter = SearchFilter(),
    config: SearchConfig = SearchConfig(),
    index: tuple[DataFrame, DataFrame] | None = None,
    vectors: VectorChannel | None = None,
) -> DataFrame:
    """Hits of one query. The best keys of each channel are found at once, a lazy plan looks up their rows.
    ``chunks`` is read several times: if making its rows takes long, pass them ``stored``. The filter holds for both channels before their limits (F3); each
    fetches ``k`` x multiplier; the shown similarity is the cosine, the order that of the fusion. Without an index
    (R10: ``index=False``) only the vector channel answers. ``vectors`` (K1) is an approximate index, which answers for the
    vector channel unless ``config.exact_search``.
    """
    fetch = k * config.fetch_multiplier
    slim = chunks.drop("page_raw_text")
    if vectors is None or config.exact_search:
        near = _nearest(slim, vector, fetch, where, config.metric)
    else:
        near = looked_up(slim, vectors.search(vector, fetch, where, metric=config.metric))
    nearest = ranked(near, [F.col("distance"), *map(F.col, KEY)])
    if config.metric != "cosine":  # what is shown is the cosine all the same
        nearest = nearest.withColumn("distance", cosine_distance(F.col("vector"), vector))
    channels = [nearest]
    if index is not False:
        worded = bm25_top_k(slim, query, fetch, where, index)
        worded = ranked(worded, [F.desc("score"), *map(F.col, KEY)]).withColumn("distance", cosine_distance(F.col("vector"), vector))
        channels.append(worded.drop("score"))
    channels = [c.drop("vector") for c in channels]
    weight = decay_weight(F.col("memory_type"), F.col("ingestion_timestamp"), now, config.decay_rate)
    fused = config.rerank(fuse(channels, k, config.rrf_k, weight))
    return hit_columns(fused.orderBy(F.desc("rrf"), "seen"))


class Retriever(Protocol):
    """What evaluations and services ask for hits, so that one way of searching can take another's place."""

    def retrieve(self, query: str, vector: list[float], k: int, where: SearchFilter = SearchFilter()) -> DataFrame: ...


@dataclass(frozen=True)
class HybridRetriever:
    """``hybrid_search`` over one table, with its indexes and its knobs held together."""

    chunks: DataFrame
    now: Column
    config: SearchConfig = SearchConfig()
    index: tuple[DataFrame, DataFrame] | None = None
    vectors: VectorChannel | None = None

    def retrieve(self, query: str, vector: list[float], k: int, where: SearchFilter = SearchFilter()) -> DataFrame:
        return hybrid_search(self.chunks, query, vector, k, self.now, where, self.config, self.index, self.vectors)


def batch_search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    fetch: int | None = None,
    rrf_k: int = 60,
    block: int | None = None,
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Hits of many queries at once: ``queries`` has query_id, text, vector. Vectors are compared in one pass over the rows for
    ``block`` queries (8,192 if not said, whose vectors are the bound of what the driver and a task hold of them), more
    queries in more passes, dealt by a hash of the id: each Arrow batch of rows meets them as one product of matrices and
    keeps the ``fetch`` nearest of each. Words are scored the same way, row by row where a row's terms are, those of stored
    postings (``index``) or of the rows, which are tokenized once: no pair of a row and a query is shuffled.
    """
    fetch = fetch or 3 * k
    block = block or 8192
    passes = max(1, -(-queries.count() // block))
    group = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    nearest = reduce(DataFrame.unionByName, [_nearest_of_each(chunks, queries.where(group == n), fetch) for n in range(passes)])
    asked = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)))).alias("term"))
    if index is None:
        rows = stored_terms(chunks)
        terms, stats = _posted(rows, KEY), _statistics(rows)
    else:
        terms, stats = index
        own = terms.join(asked.select("term").distinct(), "term", "left_semi")
        rows = own.groupBy(*KEY, "length").agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("terms"))
    df = terms.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "term").join(F.broadcast(stats), F.lit(True), "inner").select("query_id", "term", idf.alias("weight"), "avgdl")
    weights = stored(weights, "weights")
    scores = reduce(DataFrame.unionByName, [_worded_of_each(rows, weights.where(group == n), fetch) for n in range(passes)])
    worded = _top_per_query(scores, [F.desc("score"), *map(F.col, KEY)], fetch).drop("score")
    return fuse([nearest.drop("distance"), worded], k, rrf_k, group=("query_id",))


def _worded_of_each(rows: DataFrame, weights: DataFrame, fetch: int) -> DataFrame:
    asked: dict = {}
    average = 1.0
    for r in weights.collect():  # a row for each term of a block's queries
        asked.setdefault(r["query_id"], {})[r["term"]] = r["weight"]
        average = r["avgdl"]
    return batch_best(rows, KEY, asked, average, fetch, K1, B)


def _nearest_of_each(chunks: DataFrame, queries: DataFrame, fetch: int) -> DataFrame:
    asked = {r["query_id"]: r["vector"] for r in queries.select("query_id", "vector").where("vector IS NOT NULL").collect()}
    return _top_per_query(batch_top_k(chunks, KEY, "vector", asked, fetch), [F.col("distance"), *map(F.col, KEY)], fetch)


def _top_per_query(rows: DataFrame, order: list[Column], fetch: int) -> DataFrame:
    """``rank`` from 0 per query; Spark keeps the first ``fetch`` of each query in each task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).where(F.col("rank") < fetch)
