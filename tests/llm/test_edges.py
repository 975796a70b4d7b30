"""Edges of the training-data operators: large and null ids, repeats, clashing names, long texts, skew, empty tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _common, _words, fingerprints, language_id, language_model, lattice_dedup, mixing, ngram_join, packing, sharding, toxicity
from tests.llm.test_operators import EDGES, docs, reachable, shingle_set

LARGE = 1152921504606846977


def test_ids_beside_nulls_are_exact(spark):
    rows = [(LARGE, "a b c d e f g"), (None, "a b c d e f g"), (LARGE + 1, "a b c d e f g"), (7, "x y z"), (7, "a b c d e f g"), (7, "x y z")]
    found = [(r["id"], r["class_id"], r["n_links"], r["kept"]) for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted([(LARGE, 7, 2, False), (None, None, 0, True), (LARGE + 1, 7, 2, False), (7, 7, 1, True), (7, 7, 2, True), (7, 7, 1, True)], key=str)
    rows = [(LARGE, [1.0, 0.0]), (None, [1.0, 0.0]), (LARGE + 1, [2.0, 0.0]), (5, [0.0, 1.0]), (5, [1.0, 0.001])]
    found = [tuple(r) for r in lattice_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))).collect()]
    assert sorted(found, key=str) == sorted([(LARGE, 2, 5, False), (None, 0, None, True), (LARGE + 1, 2, 5, False), (5, 0, 5, True), (5, 2, 5, True)], key=str)


def test_one_of_each_beside_any_columns(spark):
    names = ["gone_id", "id", "text_key", "print", "key", "row", "slots", "times", "turn", "at", "mixed_id", "mixed_times", "node", "own"]
    given = docs(spark, [*EDGES, "a b c d e g"]).withColumns({n: F.lit(n) for n in names})
    kept = ngram_join.keep_one_of_each(given)
    assert kept.columns == given.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 7, 9]
    taken = mixing.repeat_by_mix(given)
    assert taken.columns == given.columns and {r["gone_id"] for r in taken.collect()} == {"gone_id"}
    repeated = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five"), (2, "six"), (None, "six")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["text"][:3]) for r in ngram_join.keep_one_of_each(repeated).collect()), key=str) == [(1, "one"), (2, "six"), (None, "six")]


def test_forest_finds_all_links_of_a_large_group(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(220):
        other = list(base)
        for _ in range(rng.randint(0, 4)):
            other[rng.randrange(len(other))] = f"x{rng.random()}"
        texts.append(" ".join(other))
    texts += [" ".join(base[:60] + [f"y{k}-{j}" for j in range(60)]) for k in range(60)]
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    rows = {r["id"]: r for r in ngram_join.link_documents(docs(spark, texts), rows_per_block=16).collect()}
    true = [0] * len(texts)
    for pair in links:
        for k in pair:
            true[k] += 1
    assert [rows[k]["n_links"] for k in range(len(texts))] == true and len(links) > 5000
    assert {k: r["class_id"] for k, r in rows.items()} == reachable(links, range(len(texts)))


def test_prefixes_are_shortened_to_the_recall_but_not_where_they_are_crowded(spark):
    values = {1: [1, 2, 3, 4, 5, 6, 7, 8], 2: [1, 2, 3, 4, 5, 6, 9, 9], 3: [1, 2, 3, 4, 5, 0, 0, 0], 4: [1, 2, 3, 0, 0, 0, 0, 0]}
    values |= {5: [9] * 8, 6: [9] * 8, 7: [9] * 7 + [1], 8: [9] * 5 + [1] * 3, 9: [9] * 6 + [1, 1], 10: [9] * 6 + [1, 2]}
    entries = spark.createDataFrame([(t, bytearray(np.array(v, "<u2").tobytes()), k) for k, v in values.items() for t in (0, 1)], "tree int, label binary, node long")

    def met(at_once, crowd, partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
        try:
            groups = {}
            for r in ngram_join.shortened(ngram_join.trie_nodes(entries, 8, 6, at_once), 3, crowd).collect():
                groups.setdefault(r["root"], []).append(r["id"])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        return sorted(sorted(g) for g in groups.values())

    # At 6 values 1 and 2 meet, and 5, 6, 7, 9, 10; five are a crowd, which 7 values part into 5, 6, 7 and 9, 10, and 8 into 5, 6.
    for at_once, partitions in ((1 << 20, "8"), (3, "8"), (1, "1"), (4, "2")):
        assert met(at_once, 5, partitions) == sorted([[1, 2], [5, 6, 7, 9, 10]] * 2)
        assert met(at_once, 4, partitions) == sorted([[1, 2], [5, 6, 7], [9, 10]] * 2)
        assert met(at_once, 2, partitions) == sorted([[1, 2], [5, 6], [9, 10]] * 2)


def test_words_of_pieces_are_those_of_the_whole():
    rng = random.Random(5)
    data = "".join(rng.choice("ab \n\té" + "xyz" * 5) for _ in range(3000)).encode() + b"long" * 500 + b" end "
    whole = _words.word_hashes(data)
    assert len(whole) == len(data.split()) and len(set(whole.tolist())) == len(set(data.lower().split()))
    for piece in (1, 2, 7, 100, 2999):
        assert (_words.word_hashes(data, piece=piece) == whole).all()


def test_windows_of_a_long_text_change_nothing():
    rng = random.Random(4)
    text = "".join(rng.choice("abc  éß.9\n") for _ in range(300))
    orders, buckets = (1, 2, 3, 4), 1 << 13
    count = lambda parts: np.bincount(np.concatenate(list(parts)), minlength=buckets)
    whole = count(language_id.subwords(text, orders, buckets))
    for most in (1, 2, 7, 100, 301):
        assert (count(language_id.subwords(text, orders, buckets, most)) == whole).all()
    slow = np.zeros(buckets, int)
    chars = [c.lower() if c.isalpha() else " " for c in f" {text} "]
    for n in orders:
        for at in range(len(chars) - n + 1):
            gram = chars[at : at + n]
            if " " in gram[1:-1] or set(gram) == {" "}:
                continue
            value = 2166136261 + n
            for c in gram:
                value = (value ^ ord(c)) * 16777619 % (1 << 32)
            slow[value * 2654435769 % (1 << 32) >> (32 - 13)] += 1
    assert (slow == whole).all()


def test_a_text_of_millions_of_characters(spark):
    long = docs(spark, ["the cat sat on the mat " * 120_000, "the cat sat on the mat"])
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, second = language_id.identify_languages(long, language_id.train_on_documents(base)).orderBy("doc_id").collect()
    assert first["lang_pred"] == second["lang_pred"]
    assert [r["n_links"] for r in ngram_join.link_documents(long).collect()] == [0, 0]
    rows = {r["doc_id"]: r for r in packing.pack_documents(long, packing.vocabulary(), packing.vocabulary("byte_bpe_50k.tiktoken")).where("start = 0").collect()}
    assert rows[0]["doc_tokens"] > 700_000
    assert {r["doc_id"]: r["n_chars"] for r in fingerprints.fingerprint_documents(long).collect()} == {0: 2_760_000, 1: 22}
    assert sum(r["taken"] for r in mixing.mix_documents(long).collect()) == 720_006
    assert sharding.shard_documents(long).count() == 2
    scored = language_model.score_documents(long, F.col("doc_id") < 0, hidden=4).collect()
    assert {r["n_tokens"] for r in scored} == {720_001, 7} and all(np.isfinite(r["score"]) for r in scored)


def test_rare_languages_have_their_examples(spark):
    rows = [(k, f"der hund und die katze nummer {k}", "de") for k in range(400)] + [(400 + k, f"el perro y el gato {k}", "es") for k in range(3)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language_id.train(given.repartition(n), max_documents=40) for n in (1, 7)]
    assert models[0].languages == ["de", "es"] and (models[0].table == models[1].table).all()


def test_rejection():
    scores, right = np.array([0.9, 0.8, 0.7, 0.6, 0.55]), np.array([True, True, False, True, True])
    assert language_id.rejection(scores, right, 0.995, 0.5) == pytest.approx(0.7) and language_id.rejection(scores, right, 0.995, 1.0) == 0.8
    assert language_id.rejection(scores, ~np.zeros(5, bool), 0.995, 0.3) == 0.5 and language_id.rejection(scores, np.zeros(5, bool), 0.995, 0.1) == 0.0


def test_points_of_each_source_are_as_many_as_its_slots(spark):
    sources = [("a", 1), ("b", 10**9), ("c", 3 * 10**8)]
    quota = spark.createDataFrame([(s, n, float(n), n) for s, n in sources], "source string, source_size long, target double, quota long")
    rows = mixing._slots(quota, 1 << 20, 64).orderBy("slot").collect()
    wanted = {s: -(-n // (1 << 20)) for s, n in sources}
    assert {s: sum(r["source"] == s for r in rows) for s in wanted} == wanted and len({r["slot"] for r in rows}) == len(rows)
    for s in wanted:
        assert [r["slot_block"] for r in rows if r["source"] == s] == list(range(wanted[s]))
    both = [r["source"] for r in rows if r["source"] != "a"][:900]
    for n in (13, 50, 200, 600):
        assert abs(both[:n].count("b") / n - 10 / 13) <= 8 / n
    point = lambda i: int(f"{i:032b}"[::-1], 2) / 2**32
    assert all((point(r["slot"] % 2**32) < 10 / 13 + 1e-6) == (r["source"] != "c") for r in rows)


def test_repetitions_stand_in_the_schedules_order(spark):
    texts = [f"{k} " * 40 for k in range(60)]
    given = docs(spark, texts, ["big"] * 50 + ["small"] * 10)
    kept = [r["source"] for r in mixing.repeat_by_mix(given, block_words=20).collect()]
    assert kept.count("small") == 3 * 10 and all(abs(kept[:n].count("small") / n - kept.count("small") / len(kept)) < 0.25 for n in (10, 20, 40))


def test_both_tokenizers_give_the_same_ids(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    fast, slow = packing.encoder(packing.vocabulary(), packing.vocabulary("byte_bpe_50k.tiktoken")), packing.encoder(packing.vocabulary())
    for text in [*texts, "\r\n a\u0085b", "'LL x's", "\U0001f600‍﻿", "  \t\n  ", "٣٤٥ 12345", "<|endoftext|>", "é̀"]:
        assert list(fast(text or "")) == list(slow(text or ""))


def test_sketches_of_too_few_cells_are_made_anew():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 62, 40).astype(np.uint64), rng.integers(0, 1 << 62, 3).astype(np.uint64)
    mine, other = fingerprints.differences([a], [b], 3)[0]
    assert set(mine.tolist()) == set(a.tolist()) and set(other.tolist()) == set(b.tolist())
    with pytest.raises(RuntimeError):
        fingerprints.differences([a], [b], 3, most_tries=1)


class Session:
    def __init__(self, **values):
        self.conf = self
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key.replace(".", "_"), default)

    def set(self, key, value):
        self.values[key.replace(".", "_")] = value


def test_a_cluster_needs_a_shared_folder():
    assert _common.shared_folder(Session(spark_checkpoint_dir="/shared/", spark_master="spark://x")) == "/shared"
    with pytest.raises(ValueError):
        _common.shared_folder(Session(spark_master="spark://x:7077"))
    local = Session(spark_master="local[2]")
    assert _common.shared_folder(local) == _common.shared_folder(local)


def test_class_factored_softmax_of_uneven_classes():
    rng = np.random.default_rng(2)
    net = language_model.Network.new(np.log(1000.0 / np.arange(1, 301)), 30, 6, rng, 50.0, 20.0)
    assert len(net.edges) - 1 <= 10 and net.edges[1] < net.edges[-1] - net.edges[-2]
    every = net.log_probabilities(np.repeat(rng.normal(size=(1, 6)).astype(np.float32), 302, axis=0), np.arange(302))
    assert np.exp(every.astype(float)).sum() == pytest.approx(1.0, abs=1e-4)
    flat = language_model.flat(net)
    assert (language_model.flat(language_model.with_weights(net, flat)) == flat).all()


def test_a_phrase_of_a_few_rows_changes_scores(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ant", "bee", "cow", "dog"]) for _ in range(30)) for _ in range(400)]
    for at in (371, 377, 383, 389):
        texts[at] = "gnu yak " * 60
    held = F.col("doc_id") >= 395
    texts[399] = "gnu yak " * 20
    score = lambda t: {r["doc_id"]: r["score"] for r in language_model.score_documents(docs(spark, t), held, hidden=8, per_class=2, word_least=2, block_tokens=4000).collect()}[399]
    ordered, mixed = score(texts), score([t if k not in (371, 377, 383, 389) else "gnu " * 60 + "yak " * 60 for k, t in enumerate(texts)])
    assert ordered > mixed


def test_pipeline_runs_on_edges(spark, tmp_path):
    import corpus_pipeline

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(None, None, None, None, None), (LARGE, "", "en", "s", 0), (5, "one more text of the id five", "en", "s", 28), (5, "one more text of the id five", "en", "s", 28)], base.schema)
    given = base.unionByName(more).withColumns({n: F.lit(1) for n in ("gone_id", "mixed_id", "row", "slots", "id", "key", "score", "bucket")})
    given.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/a/labels.parquet")
    packed = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert packed.count() > 0 and packed.select("doc_id").distinct().count() <= given.count()
    given.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").limit(0).write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_pipeline_filters_as_their_models_say(spark, sf_dir):
    import corpus_pipeline

    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train_on_documents(base, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in base.collect()}
    scores = dict(zip(texts, model.scores([t or "" for t in texts.values()])))
    assert {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, base, sf_dir).select("doc_id").collect()} == {k for k, s in scores.items() if s < 0.7}
    model = language_id.train_on_documents(base)
    sure = dict(zip(texts, model.scores(list(texts.values())).max(axis=1)))
    assert {r["doc_id"] for r in corpus_pipeline.keep_identified(spark, base, sf_dir).select("doc_id").collect()} == {k for k, s in sure.items() if s >= model.threshold}
    given = docs(spark, ["a b"] * 3 + ["c d e f"] * 40, ["x"] * 3 + ["y"] * 40)
    taken = {}
    for r in mixing.mix_documents(given).collect():
        taken[r["doc_id"]] = round(r["taken"] / r["size"])
    kept = [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, given, "").collect()]
    assert {k: kept.count(k) for k in taken} == taken

