"""Stored indexes of vectors and words against scoring everything."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import HashingBackend, batch_top_k, distance, pair_distance
from tessera.operators import retrieval
from tessera.operators.retrieval import SearchConfig, SearchFilter
from tessera.operators.vector_index import build_vector_index
from tessera.operators.word_index import WordIndex
from tessera.plans import search
from tessera.plans.tables import chunk_rows

ROW = "document_name string, page_number int, chunk_index int, collection string, text string, vector array<float>"


def rows(spark, n=600, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(40)]
    middle = rng.normal(size=(8, dim))
    out = []
    for k in range(n):
        text = " ".join(rng.choice(words, rng.integers(1, 30), p=np.arange(40, 0, -1) / 820))
        out.append((f"d{k // 3}", 1, k % 3, f"c{k % 4}", text, [float(x) for x in middle[k % 8] + rng.normal(size=dim) * 0.3]))
    out += [("none", 1, 0, "c0", None, None), ("zero", 1, 0, "c0", "", [0.0] * dim), ("short", 1, 0, "c1", "w1", [1.0]), ("nan", 1, 0, "c1", "W1 w2", [float("nan")] * dim)]
    return spark.createDataFrame(out, ROW)


def near(found):
    return [(r["document_name"], r["chunk_index"]) for r in found.collect()]


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_vector_index(spark, tmp_path, metric):
    chunks = rows(spark).where("document_name <> 'short' AND document_name <> 'nan'")
    index = build_vector_index(chunks, str(tmp_path / "v"), metric, cells=20)
    assert index.rows.count() == chunks.count() and 1 <= index.probes < 20
    hits = 0
    for r in chunks.where("chunk_index = 1").limit(10).collect():
        exact = near(retrieval.vector_top_k(chunks, list(r["vector"]), 10, metric=metric))
        assert near(index.search(list(r["vector"]), 10, metric=metric, exact_search=True)) == exact
        hits += len(set(near(index.search(list(r["vector"]), 10, metric=metric))) & set(exact))
    assert hits >= 90
    with pytest.raises(ValueError):
        index.search([1.0] * 12, 3, metric="l2" if metric != "l2" else "dot")
    with pytest.raises(ValueError):
        distance(F.col("vector"), [1.0], "other")


def test_index_reads_the_named_cells_and_widens_for_filters(spark, tmp_path):
    chunks = rows(spark)
    index = build_vector_index(chunks, str(tmp_path / "v"), cells=20)
    plan = index.pruned([3, 4])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    files = index.pruned([3, 4]).select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("/cell=3/" in r["f"] or "/cell=4/" in r["f"] for r in files)
    query, where = [1.0] * 12, SearchFilter(collection="c2")
    assert index.search(query, 150, where, probes=1).count() == 150 == retrieval.vector_top_k(chunks, query, 150, where).count()
    late = chunks.where("document_name = 'd5'").withColumn("document_name", F.lit("late")).withColumn("vector", F.array(*[F.lit(1.0).cast("float")] * 12))
    for c in ("page_type", "source_format", "agent_handle", "memory_type"):
        late = late.withColumn(c, F.lit(None).cast("string"))
    assert near(index.search(query, 3, unindexed=late))[:3] == [("late", 0), ("late", 1), ("late", 2)]
    assert index.search([1.0], 5).count() == 5
    empty = build_vector_index(chunks.limit(0), str(tmp_path / "e"))
    assert empty.search(query, 5).count() == 0


def test_hybrid_search_by_an_index(spark, tmp_path):
    chunks = rows(spark).where("vector IS NOT NULL AND size(vector) = 12")
    chunks = retrieval_columns(chunks)
    index = build_vector_index(chunks, str(tmp_path / "v"), cells=10)
    now = F.lit("2026-01-01").cast("timestamp")
    query = [float(x) for x in chunks.where("document_name = 'd7' AND chunk_index = 0").first()["vector"]]

    def hits(config, vectors=None):
        return [tuple(r) for r in retrieval.hybrid_search(chunks, "w1 w39", query, 5, now, config=config, vectors=vectors).collect()]

    exact = hits(SearchConfig())
    assert hits(SearchConfig(exact_search=True), index) == exact
    assert len(set(hits(SearchConfig(), index)) & set(exact)) >= 4
    held: retrieval.Retriever = retrieval.HybridRetriever(chunks, now, SearchConfig(exact_search=True), vectors=index)
    assert [tuple(r) for r in held.retrieve("w1 w39", query, 5).collect()] == exact
    assert {r["collection"] for r in held.retrieve("w1", query, 5, SearchFilter(collection="c2")).collect()} == {"c2"}
    turned = hits(SearchConfig(rerank=lambda found: found.withColumn("seen", -F.col("seen")).withColumn("rrf", F.lit(0.0))))
    assert turned != exact and sorted(turned) == sorted(exact)


def retrieval_columns(chunks):
    more = {c: F.lit("").alias(c) for c in ("page_type", "source_format", "agent_handle", "memory_type", "summary", "page_raw_text")}
    return chunks.withColumns(more | {"ingestion_timestamp": F.lit("2026-01-01").cast("timestamp")})


def worded(found):
    return [(r["document_name"], r["chunk_index"], r["score"]) for r in found.collect()]


def test_word_index_gives_the_rows_of_scoring_everything(spark, tmp_path):
    chunks = rows(spark)
    index = WordIndex(spark, str(tmp_path / "w"), zone=8)
    assert index.top_k("w1", 5).hits.count() == 0
    index.add(chunks)
    for query, where in (("w39", SearchFilter()), ("w38 w0 w12 absent", SearchFilter()), ("W1 w2", SearchFilter(collection="c3")), ("absent", SearchFilter()), ("...", SearchFilter())):
        found = index.top_k(query, 7, where, first=2)
        assert worded(found.hits) == worded(retrieval.bm25_top_k(chunks, query, 7, where))
        assert found.read <= found.blocks
    rare = index.top_k("w39 w38", 2, first=1)
    assert 0 < rare.read < rare.blocks


def test_word_index_makes_blocks_where_rows_lie(spark, tmp_path, monkeypatch):
    from tessera.operators import word_index

    index = WordIndex(spark, str(tmp_path / "w"), zone=8)
    index.add(rows(spark))
    stored = spark.read.parquet(f"{index.segments()[0]['folder']}/rows")
    want = stored.select("row", "length", F.explode("terms").alias("t")).select("t.term", F.floor(F.col("row") / 8).alias("zone"), "row", "t.tf", "length")
    blocks = spark.read.parquet(f"{index.segments()[0]['folder']}/blocks")
    assert blocks.where("most_tf <> array_max(postings.tf) OR least_length <> array_min(postings.length) OR n <> size(postings)").count() == 0
    told = blocks.select("term", "zone", F.explode("postings").alias("p")).select("term", "zone", "p.*")
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.setattr(word_index, "MOST_POSTINGS", 50)
    made = word_index._blocks_of(stored, 8)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    zipped = made.select("term", "zone", *word_index._unpacked(8)).select("term", "zone", F.explode("postings").alias("p")).select("term", "zone", "p.*")
    assert sorted(map(tuple, zipped.collect())) == sorted(map(tuple, want.collect()))


def test_word_index_of_changed_documents(spark, tmp_path):
    chunks = rows(spark)
    index = WordIndex(spark, str(tmp_path / "w"), zone=16)
    old = F.col("document_name").isin("d1", "d2", "d50")
    index.add(chunks.withColumn("text", F.when(old, "w39 w39 w39 gone").otherwise(F.col("text"))))
    changed = chunks.where(old & (F.col("document_name") != "d50"))
    index.add(changed, chunks.where(old).select("collection", "document_name"))
    now = chunks.where("document_name <> 'd50'")
    for query in ("w39 w3", "gone", "w1"):
        want = worded(retrieval.bm25_top_k(now, query, 9))
        assert worded(index.top_k(query, 9).hits) == want
    assert len(index.segments()) == 2 and not index.merge(2) and index.merge() and len(index.segments()) == 1
    assert worded(index.top_k("w39 w3", 9).hits) == worded(retrieval.bm25_top_k(now, "w39 w3", 9))


def test_distances_of_batches_are_those_of_pairs(spark):
    chunks = rows(spark).where("size(vector) = 12 OR vector IS NULL")
    asked = {1: [1.0] * 12, 2: [float(k) for k in range(12)], 3: [0.0] * 12}
    found = batch_top_k(chunks.coalesce(1), retrieval.KEY, "vector", asked, 1000).where("document_name <> 'nan'")
    queries = spark.createDataFrame([(k, v) for k, v in asked.items()], "query_id long, asked array<double>")
    pairs = chunks.where("document_name <> 'nan'").join(F.broadcast(queries), F.lit(True)).select("query_id", *retrieval.KEY, pair_distance(F.col("vector"), F.col("asked")).alias("distance"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect()))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_only_texts_of_hits_meet_vectors(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir)
    assert not [line for line in _plan(rows.select("text", "document_name")) if "Join" in line]
    plan = _plan(search.registry.queries["hybrid_search"](spark, sf_dir))
    scans = [k for k, line in enumerate(plan) if "Relation [doc_id" in line and "text#" in line]
    assert len(scans) == 2 and all("INSET" in plan[k - 1] or " IN (" in plan[k - 1] for k in scans)


def test_vectors_that_repeat_an_id_and_keys_that_are_null(spark, tmp_path):
    docs = [(1, "a b", "en", "s", 3), (2, "a", "en", "s", 1), (None, "a c", "en", "s", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    made.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = chunk_rows(spark, str(tmp_path))
    assert rows.count() == rows.select("text", "vector").count() == 4 and rows.select("text").where("text = 'a b'").count() == 2
    found = retrieval._nearest(rows, [1.0, 0.0], 4, retrieval.SearchFilter(), "cosine").collect()
    assert [(r["text"], r["distance"]) for r in found] == [("a b", 0.0), ("a b", 1.0), ("a c", 2.0), ("a", 2.0)]


def test_embedded_chunks_are_made_once(spark, sf_dir):
    plan = _plan(search.registry.queries["hashed_hybrid_search"](spark, sf_dir))
    assert not [line for line in plan if "EvalPython" in line or "Generate" in line]


def test_hashed_vectors_are_those_of_a_plain_loop():
    import re
    import zlib

    texts = ["", "One two, one TWO three_four Été", "a", "b c " * 9]
    want = np.zeros((4, 16), np.float32)
    for row, text in enumerate(texts):
        words = re.findall(r"[^\W_]+", text.lower())[:7]
        for gram in (*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))):
            h = zlib.crc32(gram.encode())
            want[row, h % 16] += 1 if h & 0x80000000 else -1
    made = HashingBackend(16, max_tokens=7).load()
    assert (made(texts) == want).all() and made([]).shape == (0, 16)
