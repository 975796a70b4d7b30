"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, fingerprints, language_id, language_model, lattice_dedup, mixing, ngram_join, packing, registry, sharding, toxicity
from tests.oracle import differences

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, langs=None):
    rows = [(k, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).withColumns({"id": F.lit(1), "root": F.lit("x"), "size": F.lit(0), "block": F.lit(0), "label": F.lit("y")})


EDGES = ["", None, "one", "one", "word " * 9000, "a b c d e f", "Ünïcode 語 text here now", " \n\t ", "a b c d e f"]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, sf_dir, name):
    assert not differences(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], sf_dir)


def needed(sizes, capacity):
    n, load = 1, 0
    for s in sizes:
        n, load = (n, load + s) if load + s <= capacity else (n + 1, s)
    return n


@pytest.mark.parametrize("n_shards", [1, 3, 24])
def test_sharding(spark, n_shards):
    texts = EDGES + [f"text {k} " * (k % 17) for k in range(300)]
    rows = sharding.shard_documents(docs(spark, texts), n_shards, cells=256).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    of_text, cells = {}, {}
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 8 and r["text_crc32"] == zlib.crc32(text.encode())
        assert of_text.setdefault(text, r["shard"]) == r["shard"]
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    placed = docs(spark, texts).select("doc_id", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(256)).alias("cell")).collect()
    size = {r["doc_id"]: r["size"] for r in rows}
    for r in placed:
        cells[r["cell"]] = cells.get(r["cell"], 0) + size[r["doc_id"]]
    ordered = [cells[c] for c in sorted(cells)]
    best = next(c for c in range(max(ordered), sum(ordered) + 1) if needed(ordered, c) <= n_shards)
    loads = {}
    for r in rows:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert max(loads.values()) <= best and set(loads) <= set(range(n_shards))
    assert sharding.shard_documents(docs(spark, texts).limit(0), n_shards).count() == 0


def shingle_set(text, n=5):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def reachable(links, ids):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def test_ngram_join(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    texts = list(EDGES)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for copies in range(rng.randint(1, 9)):
            other = list(base)
            for _ in range(rng.randint(0, 3) * (copies > 0)):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = reachable(links, range(len(texts)))
    rows = {r["id"]: r for r in ngram_join.link_documents(docs(spark, texts), rows_per_block=7).collect()}
    assert {k: r["class_id"] for k, r in rows.items()} == roots
    assert {k: r["n_links"] for k, r in rows.items()} == {k: sum(k in p for p in links) for k in range(len(texts))}
    kept = ngram_join.keep_one_of_each(docs(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == {k for k, root in roots.items() if k == root} and "label" in kept.columns
    assert ngram_join.link_documents(docs(spark, texts).limit(0)).count() == 0
    assert ngram_join.forest_depth(20, 8, 0.8, 0.995) == 6


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = EDGES + ["\n".join(f"line {rng.randint(0, 40)}." for _ in range(rng.randint(0, 120))) for _ in range(80)]
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs(spark, texts), rows_per_block=4).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for k, row in rows.items():
        text, following = texts[k] or "", texts[k - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, got in ((edited, row["near_edited"]), (following, row["near_next"])):
            a, b = set(fingerprints.digests(text).tolist()), set(fingerprints.digests(other).tolist())
            assert got == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert rows[2]["fingerprint"] == rows[3]["fingerprint"] != rows[5]["fingerprint"]
    assert fingerprints.fingerprint_documents(docs(spark, texts).limit(0)).count() == 0
    assert fingerprints.fingerprint_documents(docs(spark, ["one. two."])).first()["near_next"] == 1.0


def test_sketches_peel():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 500):
        a, b = rng.integers(0, 1 << 62, n).astype(np.uint64), rng.integers(0, 1 << 62, n // 2).astype(np.uint64)
        both = rng.integers(0, 1 << 62, 50).astype(np.uint64)
        mine, other = fingerprints.differences([np.concatenate([a, both])], [np.concatenate([b, both])], 6)[0]
        assert set(mine.tolist()) == set(a.tolist()) and set(other.tolist()) == set(b.tolist())


def test_packing(spark):
    texts = [*EDGES, "<|endoftext|> x"]
    frame = packing.pack_documents(docs(spark, texts), packing.vocabulary(), packing.vocabulary("byte_bpe_50k.tiktoken"), longest=64, with_ids=True)
    rows = frame.collect()
    encode = packing.encoder(packing.vocabulary())
    for k, text in enumerate(texts):
        pieces = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        assert [i for r in pieces for i in r["ids"]] == [*encode(text or ""), 1]
        at = 0
        for r in pieces:
            assert r["start"] == at and r["length"] == len(r["ids"]) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["length"]
        assert {r["doc_tokens"] for r in pieces} == {at}
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert packing.pack_documents(docs(spark, texts).limit(0), packing.vocabulary()).count() == 0


def test_language_model(spark):
    rng = random.Random(3)
    texts = EDGES + [" ".join(rng.choice(["the cat", "a dog", "sat on", "ran to", f"rare{k}"]) for _ in range(30)) for k in range(150)]
    held = language_id.held_out("doc_id", 7, 2)
    rows = {r["doc_id"]: r for r in language_model.score_documents(docs(spark, texts), held, vocabulary=12, most_frequent=30, per_class=4, hidden=8).collect()}
    split = lambda t: [*(t or "").lower().replace("\t", " ").replace("\n", " ").split(), ""]
    train = [w for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2 for w in split(t)]
    count = {w: train.count(w) for w in set(train)}
    whole = len(train) + len(count) + 1
    gain = 0.0
    for k, text in enumerate(texts):
        row, tokens = rows[k], split(text)
        assert row["held_out"] == (zlib.crc32(str(k).encode()) % 7 == 2) and row["train_tokens"] == len(train)
        assert (row["n_tokens"], row["n_known"]) == (len(tokens), sum(w in count for w in tokens))
        assert row["base_score"] == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / whole) for w in tokens))
        gain += (row["score"] - row["base_score"]) * row["held_out"] * (len(tokens) < 100)
    assert gain > 0
    assert language_model.score_documents(docs(spark, texts).limit(0), held).count() == 0


def test_network_is_a_distribution_and_descends():
    rng = np.random.default_rng(0)
    net = language_model.Network.new(np.zeros(10), 4, 5, rng)
    state = rng.normal(size=(1, 5)).astype(np.float32)
    every = net.log_probabilities(np.repeat(state, 12, axis=0), np.arange(12))
    assert np.exp(every).sum() == pytest.approx(1.0, abs=1e-5)
    target = rng.integers(0, 12, (3, 6))
    before, start = np.full(3, net.end), np.zeros((3, 5), np.float32)
    slope, seen_tokens, _ = language_model._slopes(net, before, start, target)
    assert list(seen_tokens) == sorted({*before, *target[:, :-1].ravel()})

    def loss():
        state, seen, total = start, before, 0.0
        for t in range(6):
            state = np.where((seen == net.end)[:, None], np.float32(0), state)
            state, _ = net.step(seen, state)
            total -= net.log_probabilities(state, target[:, t]).sum()
            seen = target[:, t]
        return total / target.size

    for name in ("gates", "change", "classes", "table"):
        value, place = getattr(net, name), np.unravel_index(np.abs(slope[name]).argmax(), slope[name].shape)
        at = (seen_tokens[place[0]], *place[1:]) if name == "table" else place  # rows of the table are those of seen tokens
        old = value[at]
        value[at] = old + 0.01
        high = loss()
        value[at] = old - 0.01
        assert (high - loss()) / 0.02 == pytest.approx(float(slope[name][place]), rel=0.05, abs=1e-4)
        value[at] = old
    texts = [rng.integers(0, 11, n) for n in (1, 7, 40, 3)]
    assert np.allclose(net.score(texts), [net.score([t])[0] for t in texts], rtol=1e-4)
    assert np.allclose(net.score(texts, at_once=4), net.score(texts), rtol=1e-4)


def test_language_id(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train_on_documents(base)
    held = base.where(language_id.held_out("doc_id", 4, 2)).select("doc_id", "lang", "text")
    found = language_id.identify_languages(held, model).join(held.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    edge = {r["doc_id"]: r for r in language_id.identify_languages(docs(spark, [*EDGES, "12 3!"]), model).collect()}
    assert {edge[k]["lang_pred"] for k in (0, 1, 7, 9)} == {"und"} and {edge[k]["score"] for k in (0, 1, 7, 9)} == {0.0}
    assert edge[5] [1:] == edge[8][1:] and 0 <= edge[4]["score"] <= 1
    assert language_id.keep_identified(docs(spark, [None, ""]), model).count() == 0
    empty = language_id.train(base.limit(0).select("doc_id", "text", "lang"))
    assert language_id.identify_languages(docs(spark, EDGES), empty).count() == len(EDGES)


def test_toxicity(spark):
    base = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train_on_documents(base, labels)
    held = labels.where(F.col("toxic").isNotNull() & language_id.held_out("doc_id", 3, 1)).select("doc_id", "toxic")
    told = {(r["toxic"], r["predicted"]): r["count"] for r in toxicity.score_toxicity(base, model).join(held, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert told.get((1, 1), 0) >= 0.9 * (told.get((1, 1), 0) + told.get((1, 0), 0)) and told.get((0, 1), 0) <= 0.02 * told.get((0, 0), 1)
    edge = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs(spark, EDGES), model).collect()}
    assert edge[0] == edge[1] and edge[2] == edge[3] and all(0 <= s <= 1 for s in edge.values())
    assert toxicity.drop_toxic(docs(spark, EDGES), model).count() == len(EDGES)
    assert toxicity.train(base.limit(0).select("text", F.lit(1).alias("toxic"))).scores(["x", None])[0] < 0.7
    xs, ys = toxicity.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0, 1, 0, 1]))
    assert list(ys) == [0, 0.5, 1] and list(xs) == [1, 2.5, 4]


def test_mixing(spark):
    rng = random.Random(5)
    texts = EDGES[:4] + ["w " * rng.randint(0, 60) for _ in range(300)]
    sources = ["tiny", None, "tiny", "b"] + [rng.choice(["big", "big", "big", "b", "c", None]) for _ in range(300)]
    rows = mixing.mix_documents(docs(spark, texts, sources), block_words=16, slot_chunk=64).collect()
    sizes = {}
    for k, text in enumerate(texts):
        sizes[sources[k]] = sizes.get(sources[k], 0) + len((text or "").split())
    ordered = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(ordered)}
    target, left, open_ = {}, sum(sizes.values()), dict(weight)
    while open_:
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > 3 * sizes[s]]
        if not over:
            target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in over}
    taken = {}
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(rows) == len(texts) and all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix_documents(docs(spark, texts, sources).repartition(5), block_words=16, slot_chunk=64).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}
    assert mixing.mix_documents(docs(spark, texts).limit(0)).count() == 0 and mixing.mix_documents(docs(spark, [None, ""])).count() == 2


CHAT = "conv_id long, turn long, role string, text string"


def whole_dialogues(rows):
    """conv_id and perspective to the text and the mask spans of the whole rendering, without Spark."""
    marked = lambda t: re.sub(r"<(\\*)\|", r"<\\\1|", t)
    out = {}
    filled = [(c, -1 if t is None else t, "unknown" if r is None else r, x or "") for c, t, r, x in rows]
    for conv in {r[0] for r in filled}:
        own = sorted((r for r in filled if r[0] == conv), key=lambda r: (r[1], hashlib.md5(f"{r[2]}\n{r[3]}".encode()).hexdigest(), r[2], r[3]))
        for name in {r[2] for r in own} - {"system"}:
            text, spans = "", []
            for _, _, who, said in own:
                user = re.sub(r"\|(\\*)>", r"|\\\1>", marked(who))
                text += "<|assistant|>\n" if who == name else "<|system|>\n" if who == "system" else f"<|user name={user}|>\n"
                begin = len(text)
                text += marked(said) + "<|end|>"
                if who == name:
                    spans.append((begin, len(text)))
                text += "\n"
            out[conv, name] = text, spans
    return out


@pytest.mark.parametrize("rows_per_part", [3, 64])
def test_chat(spark, rows_per_part):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 70, "ann", "later"), (2, 0, "system", "alone"), (3, None, None, "x"), (3, None, None, "x")]
    rows += [(None, 0, "zed", "n"), (None, 5, "yan", "m"), (4, 1, "a|>\n<|system", "say <|end|> and <\\|"), (4, 1, "b", "tie"), (4, 1, "a", "")]
    rows += [(5, k, ("ann", "bob", "system")[k % 3], f"t{k}") for k in range(130)] + [(6, 9, "ann", f"n{k % 150}") for k in range(200)]
    frame = spark.createDataFrame(rows, CHAT).withColumns({"part": F.lit(9), "start": F.lit("x"), "head": F.lit(1)})
    found, true = {}, whole_dialogues(rows)
    for r in sorted(chat_format.render_dialogues(frame, rows_per_part=rows_per_part).collect(), key=lambda r: r["part"]):
        text, spans, turns = found.setdefault((r["conv_id"], r["perspective"]), ["", [], 0])
        assert r["start"] == len(text) and 0 < r["n_turns"] <= rows_per_part
        own = [tuple(map(int, s.split("-"))) for s in r["mask_spans"].split(",") if s]
        assert sum(b - a for a, b in own) == r["target_chars"] and len(own) == r["n_target_turns"]
        found[r["conv_id"], r["perspective"]] = [text + r["text"], spans + own, turns + r["n_turns"]]
    assert {k: (t, s) for k, (t, s, _) in found.items()} == true and (2, "system") not in found
    assert found[5, "ann"][2] == 130 and found[None, "zed"][2] == 2
    assert chat_format.render_dialogues(spark.createDataFrame([], CHAT)).count() == 0


def test_a_dialogue_of_many_turns(spark):
    turns = spark.range(100_000).select(F.lit(1).alias("conv_id"), (F.col("id") % 50_000).alias("turn"), F.concat(F.lit("p"), F.col("id") % 2).alias("role"), F.col("id").cast("string").alias("text"))
    rows = chat_format.render_dialogues(turns).select("perspective", "part", "start", F.length("text").alias("n"), "n_turns", "n_target_turns").orderBy("perspective", "part").collect()
    assert len(rows) == 2 * 1563 and sum(r["n_target_turns"] for r in rows) == 100_000 == sum(r["n_turns"] for r in rows) / 2
    assert all(a["perspective"] != b["perspective"] or b["start"] == a["start"] + a["n"] for a, b in zip(rows, rows[1:]))


def test_lattice(spark):
    rng = np.random.default_rng(4)
    vectors, labels = [], []
    for g in range(25):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            vectors.append((base + rng.normal(size=16) * rng.choice([0.02, 0.12])).tolist())
            labels.append(int(g % 3))
    vectors += [vectors[0], [v * 2 for v in vectors[0]], None, [0.0] * 16, [float("nan")] * 16, [], vectors[0], [None, 1.0]]
    labels += [labels[0], labels[0], 0, 0, 0, 0, None, 0]
    rows = [(k, v, lab) for k, (v, lab) in enumerate(zip(vectors, labels))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit(0), "root": F.lit(0)})
    fine = [k for k, v in enumerate(vectors) if labels[k] is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {k: np.array(vectors[k]) / np.linalg.norm(vectors[k]) for k in fine}
    links = [(a, b) for a in fine for b in fine if b < a and labels[a] == labels[b] and unit[a] @ unit[b] >= 0.98]
    roots = reachable(links, range(len(rows)))
    found = {r["id"]: r for r in lattice_dedup.link_vectors(frame, rows_per_block=5).collect()}
    true = {k: sum(k in p for p in links) for k in range(len(rows))}
    assert sum(r["n_links"] for r in found.values()) >= 0.97 * sum(true.values())
    assert all(found[k]["n_links"] <= true[k] for k in found) and sum(found[k]["component_id"] == roots[k] for k in found) >= 0.97 * len(rows)
    assert lattice_dedup.link_vectors(frame.limit(0)).count() == 0


def test_lattice_points_are_nearest():
    y = np.random.default_rng(1).normal(size=(200, 8)) * 2
    point, distance = lattice_dedup.nearest_d8(y, False)
    assert (np.rint(point.sum(axis=1)) % 2 == 0).all() and np.allclose(((y - point) ** 2).sum(axis=1), distance)
    for k in range(8):
        for step in (-1, 1):
            for j in range(8):
                other = point.copy()
                other[:, k] += step
                other[:, j] += 1 if j != k else step
                assert (((y - other) ** 2).sum(axis=1) >= distance - 1e-9).all()


def test_pipeline_stages(spark, sf_dir, monkeypatch):
    import corpus_pipeline

    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = base
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, held, sf_dir)
        assert after.columns == base.columns, name
        ids = {r[0] for r in held.select("doc_id").collect()}
        kept = [r[0] for r in after.select("doc_id").collect()]
        assert set(kept) <= ids and kept
        if name == "near_copies":
            texts = {r["doc_id"]: shingle_set(r["text"]) for r in held.select("doc_id", "text").collect()}
            links = [(a, b) for a in texts for b in texts if b < a and texts[a] and texts[b] and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])]
            assert set(kept) == {k for k, root in reachable(links, texts).items() if k == root}
        held = after
    last = corpus_pipeline.STAGES[-1][1](spark, held, sf_dir)
    assert last.select("doc_id").distinct().count() == held.select("doc_id").distinct().count()


def test_language_model_learns_from_every_row(spark, monkeypatch):
    texts = [f"w{k} w{k} w{(k * 7) % 500}" for k in range(500)] * 4
    given = docs(spark, texts)
    held = F.col("doc_id") < 0
    seen = {}
    whole = language_model.train

    def told(ids, net, n_blocks, passes, **more):
        seen.update(rows=ids.count(), blocks=ids.select("block").distinct().count(), n_blocks=n_blocks, n_words=net.n_words)
        return whole(ids, net, n_blocks, passes, **more)

    monkeypatch.setattr(language_model, "train", told)
    rows = language_model.score_documents(given, held, hidden=4, per_class=32, block_tokens=1000, word_least=4).collect()
    assert len(rows) == len(texts) and seen == {"rows": len(texts), "blocks": 8, "n_blocks": 8, "n_words": 500}


def test_training_reads_each_block_and_averages_by_tokens(spark):
    rng = np.random.default_rng(1)
    net = language_model.Network.new(np.zeros(6), 3, 4, rng)
    texts = [[*rng.integers(0, 6, 5 + k % 7).tolist(), net.end] for k in range(60)]
    rows = [(k % 3, k, bytearray(np.array(t, np.int32).tobytes())) for k, t in enumerate(texts)]
    made = language_model.train(spark.createDataFrame(rows, "block int, key long, ids binary"), net, 3, 1)

    def block(k, start, done):
        fitter = language_model.Fitter(language_model.with_weights(start, language_model.flat(start)))
        run = np.array([w for at, t in enumerate(texts) if at % 3 == k for w in t], np.int64)
        fitter.run(run, lambda x: 0.01 * max(0.05, 1 - done - x / 2))
        return language_model.flat(fitter.net), len(run)

    first = language_model.with_weights(net, block(0, net, 0.0)[0])
    (a, n), (b, m) = block(1, first, 0.5), block(2, first, 0.5)
    assert np.allclose(language_model.flat(made), (a.astype(float) * n + b.astype(float) * m) / (n + m), atol=1e-6)
    assert not np.allclose(language_model.flat(first), language_model.flat(net))


def test_pipeline_packs_token_ids(spark):
    import corpus_pipeline

    texts = ["one two three " * 50, "", "a"]
    rows = corpus_pipeline.pack(spark, docs(spark, texts), "").collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert {r["doc_id"] for r in rows} == {0, 1, 2}
