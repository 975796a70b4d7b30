"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import documents, drawn
from tessera.llm.language_id import held_out

#: Second-person words of four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos tú ti usted ustedes su sus vosotros".split())
#: Characters that stand for letters in obfuscated words.
STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")
WORDS = re.compile(r"[^\W_]+")
OBFUSCATED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[0-9@$!*|])[^\W_]+(?:[0-9@$!*|]+[^\W_]+)+")
STEM = 5
FEATURES = (
    "hits per word", "weight per word", "largest weight", "distinct hits (log)", "hits (log)", "stem hits per word", "distinct stems (log)",
    "hits near second person per word", "capitals per letter", "shouted words per word", "exclamations per char", "questions per char",
    "punctuation per char", "obfuscated words per word", "words (log)", "word length",
)


def features(text: str | None, lexicon: dict[str, float], near: int = 5) -> list[float]:
    """One value for each of FEATURES. ``lexicon`` has weights of words, and of stems as ``stem*``. The whole text counts."""
    text = text or ""
    low = text.lower()
    plain = low
    strange = 0
    if OBFUSCATED.search(low):
        plain, strange = OBFUSCATED.subn(lambda m: m[0].translate(STANDS_FOR).replace("*", ""), low)
    words = WORDS.findall(plain)
    n = max(1, len(words))
    hits: list[tuple[int, str]] = []
    stems: list[str] = []
    you: list[int] = []
    for at, word in enumerate(words):
        if word in lexicon:
            hits.append((at, word))
        if (stem := word[:STEM] + "*") in lexicon:
            stems.append(stem)
        if word in SECOND_PERSON:
            you.append(at)
    close = 0
    if you and hits:
        places = np.array(you)
        spots = np.array([at for at, _ in hits])
        right = np.minimum(np.searchsorted(places, spots), len(places) - 1)
        left = np.maximum(right - 1, 0)
        close = int(((np.abs(places[right] - spots) <= near) | (np.abs(places[left] - spots) <= near)).sum())
    weights = [lexicon[w] for _, w in hits]
    letters = sum(map(len, words))
    capitals = sum(a != b for a, b in zip(text, low)) if len(text) == len(low) else sum(c.isupper() for c in text)
    chars = max(1, len(text))
    shouted = sum(len(w) > 2 and w.isupper() for w in text.split()) if capitals else 0
    spaces = low.count(" ") + low.count("\n")
    return [
        len(hits) / n, sum(weights) / n, max(weights, default=0.0), float(np.log1p(len({w for _, w in hits}))), float(np.log1p(len(hits))),
        len(stems) / n, float(np.log1p(len(set(stems)))), close / n, capitals / max(1, letters), shouted / n, low.count("!") / chars,
        low.count("?") / chars, max(0, len(text) - letters - spaces) / chars, strange / n, float(np.log1p(len(words))), letters / n,
    ]


@dataclass
class Trees:
    """Boosted regression trees of equal depth on the log-odds: node k of a tree has children 2k+1 and 2k+2."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 1.0) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        score = np.full(len(y), start)
        inner, leaves = (1 << depth) - 1, 1 << depth
        feature, cut, leaf = np.zeros((rounds, inner), int), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
        for r in range(rounds):
            p = 1 / (1 + np.exp(-score))
            slope, bend = y - p, p * (1 - p)
            node = np.zeros(len(y), int)
            for level in range(depth):
                first = (1 << level) - 1
                width = 1 << level
                best = np.full(width, 1e-6)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    cell = (node - first) * bins + code[:, j]
                    g = np.bincount(cell, slope, width * bins).reshape(width, bins).cumsum(axis=1)
                    h = np.bincount(cell, bend, width * bins).reshape(width, bins).cumsum(axis=1)
                    ga, ha = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + least) + (ga - g) ** 2 / (ha - h + least) - ga**2 / (ha + least)
                    gain = gain[:, : len(e)]
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    for k in np.nonzero(top > best)[0]:
                        best[k], feature[r, first + k], cut[r, first + k] = top[k], j, e[at[k]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[r, node]] > cut[r, node])
            place = node - inner
            leaf[r] = rate * np.bincount(place, slope, leaves) / (np.bincount(place, bend, leaves) + least)
            score += leaf[r][place]
        return cls(start, feature, cut, leaf)

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        every, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), int)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[every, feature[node]] > cut[node])
            score += leaf[node - inner]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising line from scores to the rate of ones: blocks that pool adjacent violators, at their mean score."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order].astype(float)):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2] + s2]
    xs = np.array([s / n for _, n, s in blocks])
    ys = np.array([v / n for v, n, _ in blocks])
    return xs, ys


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Trees
    xs: np.ndarray
    ys: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
        raw = self.trees.predict(x)
        # A little of the raw score keeps the order of texts within a flat part of the calibrated line.
        return np.clip(0.999 * np.interp(raw, self.xs, self.ys) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)

    def column(self, text: Column) -> Column:
        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series(self.scores(texts.tolist()))

        return score(text)


def learn_lexicon(texts: DataFrame, size: int = 4000, least: int = 3) -> list[dict[str, float]]:
    """Lexicons of fold 0, of fold 1 and of both: words and stems that texts labelled 1 hold far more often.

    ``texts`` has text, fold, toxic. Texts that hold a word are counted per fold; words in at least ``least`` texts of
    label 1, and eight times as often there as in the others, stay, with their log odds, at most ``size`` of each fold.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    stems = F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*"))))
    total = {(r["fold"], r["toxic"]): r["n"] for r in texts.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = texts.select("fold", "toxic", F.explode(F.concat(words, stems)).alias("word")).groupBy("word")
    seen = seen.agg(*[F.count(F.when((F.col("fold") == f) & (F.col("toxic") == t), 1)).alias(f"n{f}{t}") for f in (0, 1) for t in (0, 1)])
    out = []
    for folds in ((0,), (1,), (0, 1)):
        ones, zeros = (sum(total.get((f, t), 0) for f in folds) for t in (1, 0))
        a, b = (sum(F.col(f"n{f}{t}") for f in folds) for t in (1, 0))
        odds = F.log(((a + 0.1) / (ones + 1.0)) / ((b + 0.1) / (zeros + 1.0)))
        rows = seen.where(a >= least).select("word", odds.alias("odds"), a.alias("a")).where(F.col("odds") > 2.0)
        out.append({r["word"]: r["odds"] for r in rows.orderBy(F.desc("a"), "word").limit(size).collect()})
    return out


def train(labelled: DataFrame, seed: int = 11) -> ToxicityModel:
    """Fit on (text, toxic) rows, a number of rows that the driver's memory can hold as numbers.

    Copies of a text count once; a text labelled both ways counts as 0. The lexicon of either half of the drawn texts gives the features of the other half,
    so that words that only seem telling do not; trees are grown on three quarters of these rows and calibrated on
    the rest. The final lexicon is that of all drawn texts. The driver gets lexicons and numbers, no texts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = labelled.where(F.col("toxic").isNotNull())
    rows = rows.select(text.alias("text"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64(text).alias("print"))
    folded = rows.withColumn("fold", F.pmod("print", F.lit(2)).cast("int")).dropDuplicates(["print", "toxic"]).persist()
    try:
        lexicons = learn_lexicon(folded)

        @F.pandas_udf("array<double>")
        def measured(texts: pd.Series, folds: pd.Series) -> pd.Series:
            return pd.Series([features(t, lexicons[1 - f]) for t, f in zip(texts, folds)])

        rows = folded.select("print", "toxic", measured("text", "fold").alias("x")).toPandas()
    finally:
        folded.unpersist()
    rows = rows.sort_values(["print", "toxic"]).drop_duplicates("print")
    x, y = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES)), rows["toxic"].to_numpy(float)
    if not len(y):
        return ToxicityModel({}, Trees(-5.0, np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8))), np.array([0.0]), np.array([0.0]))
    part = np.random.default_rng(seed).permutation(len(y)) % 4
    trees = Trees.fit(x[part > 0], y[part > 0])
    aside = part == 0 if (part == 0).sum() >= 20 else part >= 0
    xs, ys = isotonic(trees.predict(x[aside]), y[aside])
    return ToxicityModel(lexicons[2], trees, xs, ys)


def train_on_documents(docs: DataFrame, labels: DataFrame, max_documents: int = 20000, seed: int = 11) -> ToxicityModel:
    """Fit on documents with a label that aren't held out; about ``max_documents`` labels are drawn by a hash of doc_id,
    which also bounds what is broadcast to find their texts.
    """
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out("doc_id", 3, 1)).select("doc_id", "toxic")
    marked = drawn(marked, max_documents, seed).withColumnRenamed("doc_id", "labelled")
    return train(docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("labelled")))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for each row of ``docs``. A null or empty text has no hits and gets the score of that;
    rows that repeat get the same score, null ids too; a score of just ``threshold`` is predicted 1. An empty table gives an
    empty one. Texts of any length are measured whole. Of ``docs`` only doc_id and text are read.
    """
    scored = docs.select("doc_id", model.column(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their own columns: those at it go. A null text is measured as
    an empty one; rows that repeat, and those of a null doc_id, stay or go like others; an empty table gives an empty one.
    """
    return docs.where(model.column(F.col("text").cast("string")) < threshold)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_on_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
