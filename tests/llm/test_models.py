"""The trained models against plain loops, and the edges of what they score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, language_id, language_model, sharding, toxicity
from tests.llm.test_operators import docs


def test_a_tree_takes_the_best_split():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (200, 4)).astype(float)
    y = ((x[:, 2] > 3) ^ (rng.random(200) < 0.1)).astype(float)
    trees = toxicity.Trees.fit(x, y, rounds=1, depth=1, bins=8)
    p = 1 / (1 + np.exp(-trees.start))
    slope, bend = y - p, np.full(len(y), p * (1 - p))

    def gain(j, cut):
        side = x[:, j] <= cut
        part = lambda m: slope[m].sum() ** 2 / (bend[m].sum() + 1.0)
        return part(side) + part(~side) - part(side | True)

    cuts = [(j, c) for j in range(4) for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1]))]
    assert gain(trees.feature[0, 0], trees.cut[0, 0]) == pytest.approx(max(gain(j, c) for j, c in cuts))
    left = x[:, trees.feature[0, 0]] <= trees.cut[0, 0]
    for side, leaf in ((left, 0), (~left, 1)):
        assert trees.leaf[0, leaf] == pytest.approx(0.15 * slope[side].sum() / (bend[side].sum() + 1.0))


def test_predictions_are_walks_from_the_roots():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 5)), (rng.random(300) < 0.4).astype(float)
    trees = toxicity.Trees.fit(x, y, rounds=12, depth=3, bins=16)
    for row, found in zip(x, trees.predict(x)):
        score = trees.start
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            score += leaf[node - len(feature)]
        assert found == pytest.approx(score)


def test_toxicity_edges(spark):
    train = [("you are a zorg and a blart", 1), ("nice weather for a walk", 0), ("have a good day all", 0)] * 1
    rows = [(k, f"{t} {k}", v) for k, (t, v) in enumerate(train * 60)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    texts = [None, "", "you zorg blart", "you zorg blart", "a walk " * 200_000, "you zorg blart " * 50_000]
    found = toxicity.score_toxicity(docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 2, F.col("doc_id"))), model).collect()
    score = {r["doc_id"]: r["score"] for r in found}
    assert len(found) == 6 and score[0] == score[1] and score[None] == score[3] and all(0 <= s <= 1 for s in score.values())
    assert score[3] > score[0] and score[5] > score[4]
    at = score[3]
    assert [r["predicted"] for r in toxicity.score_toxicity(docs(spark, texts[3:4]), model, at).collect()] == [1]
    kept = toxicity.drop_toxic(docs(spark, texts), model, at).collect()
    assert [r["doc_id"] for r in sorted(kept, key=lambda r: r["doc_id"])] == [k for k in range(6) if model.scores([texts[k]])[0] < at]
    assert toxicity.drop_toxic(docs(spark, texts).limit(0), model).count() == 0


def small_languages(threshold=0.6):
    rng = np.random.default_rng(3)
    return language_id.LanguageModel(["aa", "bb", "cc"], rng.normal(0, 3, (1 << 10, 3)).astype(np.float32), np.array([0.1, 0.0, -0.1]), threshold, (1, 2, 3), 1 << 10)


def test_language_scores_are_softmaxes_of_mean_rows(spark):
    model = small_languages()
    texts = ["one two three", "Ünï", "x" * 5000, "a b", "1234", "", None]
    found = model.scores(texts)
    for text, row in zip(texts, found):
        ids = [i for part in language_id.subwords(text or "", model.orders, model.buckets) for i in part]
        if not ids:
            assert np.isnan(row).all()
            continue
        z = [sum(float(model.table[i, k]) for i in ids) / len(ids) + model.bias[k] for k in range(3)]
        e = [np.exp(v - max(z)) for v in z]
        assert row == pytest.approx([v / sum(e) for v in e])
    told = {r["doc_id"]: r for r in language_id.identify_languages(docs(spark, texts + texts[:1]), model).collect()}
    for k, text in enumerate(texts[:4]):
        assert told[k]["lang_pred"] == model.languages[int(found[k].argmax())] and told[k]["accepted"] == bool(found[k].max() >= 0.6)
    assert [told[k]["lang_pred"] for k in (4, 5, 6)] == ["und"] * 3 and told[7]["score"] == told[0]["score"]
    kept = language_id.keep_identified(docs(spark, texts + texts[:1]).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id"))), small_languages(0.0))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [0, 1, 2, 3, None]


def test_a_text_scores_what_its_tokens_score_one_by_one():
    rng = np.random.default_rng(5)
    net = language_model.Network.new(np.log([9.0, 7.0, 5.0, 3.0, 2.0, 1.0, 1.0]), 3, 4, rng)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for text in ([net.end], [0, 3, 6, net.unknown, 2, net.end], list(rng.integers(0, net.n_words, 70)) + [net.end]):
        state, before, total, h = np.zeros(4), net.end, 0.0, 4
        for token in text:
            x = net.table[before].astype(float) @ net.into + net.shift
            keep, reset = sigmoid(x[:h] + state @ net.gates[:, :h]), sigmoid(x[h : 2 * h] + state @ net.gates[:, h:])
            new = np.tanh(x[2 * h :] + reset * (state @ net.change))
            state = new + keep * (state - new)
            kinds = state @ net.classes + net.class_bias
            kind = int(np.searchsorted(net.edges, token, side="right") - 1) if token < net.n_words else len(net.edges) - 1 + token - net.n_words
            total += kinds[kind] - np.log(np.exp(kinds).sum())
            if token < net.n_words:
                own = slice(net.edges[kind], net.edges[kind + 1])
                inner = net.inner[own] @ state + net.inner_bias[own]
                total += inner[token - net.edges[kind]] - np.log(np.exp(inner).sum())
            before = token
        assert net.score([np.array(text)])[0] == pytest.approx(total / np.log(10), rel=1e-4)


def test_words_of_slices_are_those_of_whole_texts(spark):
    texts = [None, "", " \x0b\x0c\t", "  A b\x0b\x0cC\x1cd\r\n", "É é Z\u0085q İ\u00a0K ", "x" * 50, None, "the The tHE", "É" * 40 + " \n a"]
    plain = [(t or "").encode().lower().split() for t in texts]
    for most in (1, 60, 1 << 20):
        cuts = list(language_model.slices(pa.array(texts), most))
        assert [k for a, b in cuts for k in range(a, b)] == list(range(len(texts))) and (most > 1 or len(cuts) > 4)
        for a, b in cuts:
            found, n = language_model.words(pa.array(texts).slice(a, b - a))
            assert found.to_pylist() == [w for t in plain[a:b] for w in t] and n.tolist() == [len(t) for t in plain[a:b]]
    assert not list(language_model.slices(pa.array([], pa.string())))
    known = language_model.Lexicon([b"the", b"a", b"x"], np.array([9, 4, 1]), 2, 1)
    rows = docs(spark, texts).select("doc_id", F.lit(False).alias("held_out"), F.lit(0).alias("block"), F.lit(1).cast("long").alias("key"), "text")
    made = {r["doc_id"]: r for r in language_model.as_ids(rows, known, 5).collect()}
    assert len({r["uid"] for r in made.values()}) == len(texts)
    for k, own in enumerate(plain):
        row, rare = made[k], [w for w in own if w not in known.tokens]
        assert np.frombuffer(row["ids"], np.int32).tolist() == [{b"the": 0, b"a": 1}.get(w, 2) for w in own] + [3]
        assert [bytes(w) for w in row["rare"]] == rare and row["n_tokens"] == len(own) + 1 and row["n_known"] == len(own) - len(rare) + 1
        assert row["n_unknown"] == len(rare) + own.count(b"x") and row["unknown_log"] == pytest.approx(own.count(b"x") * np.log10(2))
        assert row["frequent_log"] == pytest.approx(sum(np.log10({b"the": 10, b"a": 5, b"x": 2}[w]) for w in own if w not in rare) + np.log10(6))


@pytest.mark.parametrize("scale", [1, 400])
def test_slopes_of_all_weights_are_those_of_differences(scale):
    """Over two windows and an end, where exponentials need no shift (1) and where they do (400)."""
    rng = np.random.default_rng(4)
    net = language_model.Network.new(np.log([9.0, 7.0, 5.0, 3.0, 2.0, 1.0, 1.0]), 3, 4, rng, 2.0, 3.0)
    net.inner *= scale
    before, target = np.array([0, net.end, 3]), rng.integers(0, net.n_words + 2, (3, 8))
    target[1, 3] = net.end
    start = rng.uniform(-0.9, 0.9, (3, 4)).astype(np.float32)
    assert net.outputs(start)[2] == (scale == 1)
    slope, seen, after = language_model._slopes(net, before, start, target)
    values = {k: getattr(net, k).astype(float) for k in language_model.WEIGHTS}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def loss():
        total, ends = 0.0, []
        for token, state, row in zip(before, start.astype(float), target):
            for goal in row:
                state = state * (token != net.end)
                x = values["table"][token] @ values["into"] + values["shift"]
                keep, reset = sigmoid(x[:4] + state @ values["gates"][:, :4]), sigmoid(x[4:8] + state @ values["gates"][:, 4:])
                new = np.tanh(x[8:] + reset * (state @ values["change"]))
                state = new + keep * (state - new)
                kind = int(net.kinds[goal])
                logits = [(state @ values["classes"] + values["class_bias"], kind)]
                if goal < net.n_words:
                    own = slice(net.edges[kind], net.edges[kind + 1])
                    logits.append((values["inner"][own] @ state + values["inner_bias"][own], goal - net.edges[kind]))
                total -= sum(z[at] - z.max() - np.log(np.exp(z - z.max()).sum()) for z, at in logits)
                token = goal
            ends.append(state)
        return total / target.size, ends

    assert np.allclose(after, loss()[1], atol=1e-5)
    for name in language_model.WEIGHTS:
        found = slope[name]
        if name == "table":
            found = np.zeros(net.table.shape)
            found[seen] = slope[name]
        for place in np.ndindex(found.shape):
            old = values[name][place]
            sides = []
            for move in (1e-5, -1e-5):
                values[name][place] = old + move
                sides.append(loss()[0])
            values[name][place] = old
            assert found[place] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=2e-3, abs=2e-5 * scale), (name, place)


def test_shards_and_dialogues_of_long_texts_and_null_ids(spark):
    long = "word " * 400_000
    rows = docs(spark, [long, "a", "b", None]).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id")))
    found = sharding.shard_documents(rows, 3).collect()
    assert len(found) == 4 and sum(r["doc_id"] is None for r in found) == 2 and max(r["size"] for r in found) == len(long) + 8
    turns = spark.createDataFrame([(1, 0, "ann", long), (1, 1, "bob", "b")], "conv_id long, turn long, role string, text string")
    told = {r["perspective"]: r for r in chat_format.render_dialogues(turns).collect()}
    assert told["ann"]["target_chars"] == len(long) + len("<|end|>") and long in told["bob"]["text"]
