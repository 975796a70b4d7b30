"""Nearest neighbours and centroid clustering against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, nearest

VECTOR = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VECTOR).selectExpr(
        "*", "1 AS node", "2 AS ids", "'x' AS print", "3 AS cell", "4 AS rank", "5 AS cluster", "6 AS key"
    )


ODD = [(None, [1.0] * 64), (9000, None), (9020, []), (9040, [0.0] * 64), (9060, [float("nan")] * 64), (9080, [float("inf")] + [1.0] * 63), (9100, [None] * 64)]


def exact(rows, k=20):
    """query -> [(id, score)] by comparing all."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None for x in v)]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            scored = [(-float(np.cumsum(v * w)[-1]), i) for i, w in good if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def told(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_neighbours_of_edges_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = ODD + [(k, rng.normal(size=64)) for k in range(60)] + [(100 + k, [1.0, 2.0, 3.0]) for k in range(90)]
    rows += [(400, [3.0]), (420, [2.0]), (421, [-1.0])] + [(500 + k, rng.integers(0, 2, 5)) for k in range(1, 60)]
    rows.append((100, [1.0, 2.0, 3.0]))
    found = told(nearest.nearest_vectors(frame(spark, rows), F.col("vec_id") % 20 == 0, recall=1.0, rows_per_block=16))
    want = {q: n for q, n in exact(rows[:-1]).items() if n}
    assert found == want
    assert nearest.nearest_vectors(frame(spark, []), F.lit(True)).count() == 0


def test_recall_with_unequal_lengths_and_a_hot_vector(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2.0, (3000, 1))
    x[::3] = x[0]
    x[1::30] = x[0] + rng.normal(size=(100, 32)) * 0.01
    rows = [(k, v) for k, v in enumerate(x)]
    want = exact(rows)
    got = told(nearest.nearest_vectors(frame(spark, rows), F.col("vec_id") % 20 == 0, rows_per_cell=32, rows_per_block=64))
    assert set(got) == set(want) and all(len(n) == 20 for n in got.values())
    scores = {(q, i): s for q, n in want.items() for i, s in n}
    assert all(scores[q, i] == s for q, n in got.items() for i, s in n if (q, i) in scores)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in n}) / 20 for q, n in want.items()]) >= 0.9


def test_pseudo_rotations_keep_lengths_and_probes_are_the_best_sums():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 16))
    assert np.allclose((nearest.hadamard(x) ** 2).sum(axis=1), (x**2).sum(axis=1))
    made = nearest.Polytopes(30, 1 << 8, 3, 1)
    assert made.width == 32 and made.cells == 256 and made.axes == [32, 2]
    unit = nearest._direction(rng.normal(size=(4, 30)))
    homes, probes = made.homes(unit), made.probes(unit, 10, range(3))
    for row in range(4):
        for t, (first, second) in enumerate(made.sides(unit)):
            sums = {t * 256 + i * 4 + j: first[row, i] + second[row, j] for i in range(64) for j in range(4)}
            best = set(sorted(sums, key=sums.get)[-10:])
            assert set(probes[row, 10 * t : 10 * t + 10]) == best and homes[row, t] == max(sums, key=sums.get)
    assert (made.ranks(unit[:1], homes[:1]) == 1).all()


def lloyd(rows, clusters=8, rounds=10):
    """The contract with Python's numbers."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in seeds[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cs))

    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        cs = [[sum(col) // len(of[k]) for col in zip(*of[k])] if k in of else c for k, c in enumerate(cs)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = {k: sum(d for _, d, c in last if c == k) for k in range(len(cs))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, d, k in last), key=repr)


@pytest.mark.parametrize("n", [0, 3, 150])
def test_clusters_of_edges(spark, n):
    rng = np.random.default_rng(n)
    rows = [(k, rng.normal(size=64) * 0.1) for k in range(n)] + ([(1000 + k, [0.25] * 64) for k in range(200)] + ODD + [(5, [0.5] * 64), (5, [0.5] * 64), (7, [1.0] * 63), (8, [-3.3] * 64)]) * (n > 3)
    found = sorted((tuple(r) for r in centroids.cluster_vectors(frame(spark, rows)).collect()), key=repr)
    assert found == (lloyd(rows) if n else [])


def test_quantised_components_are_bounded(spark):
    rows = frame(spark, [(1, [3e38] + [-3e38] * 63), (2, [0.0] * 64)])
    assert {r["id"]: r["distance"] for r in centroids.cluster_vectors(rows, clusters=1, rounds=0).collect()}.keys() == {1, 2}
    key = centroids.quantised(rows, "vec_id", "embedding", 64, 1024).where("id = 1").first()["key"]
    assert list(np.frombuffer(key, "<i4")[:2]) == [centroids.WIDEST, -centroids.WIDEST]
