"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import documents

UNKNOWN = "und"
#: Characters taken at once; bounds the memory of a worker.
AT_ONCE = 1 << 21


@cache
def _folded() -> np.ndarray:
    """For each code point its lower-case form, or a space if it isn't a letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c <= 0xDFFF and (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def subwords(text: str, orders: tuple[int, ...], buckets: int, at_once: int = AT_ONCE) -> Iterable[np.ndarray]:
    """Buckets of all character n-grams that lie within a word or touch one of its ends, some arrays for each order.

    A long text goes through in windows of ``at_once`` beginnings of n-grams, each with the characters after it that
    these reach into, so windows change nothing.
    """
    padded = f" {text} "
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for at in range(0, len(padded), at_once):
        points = np.frombuffer(padded[at : at + at_once + max(orders) - 1].encode("utf-32-le", "replace"), dtype=np.uint32)
        chars = _folded()[np.minimum(points, 0x10FFFF)]
        gap = chars == 32
        for n in orders:
            size = min(len(chars) - n + 1, at_once)
            if size <= 0:
                continue
            value = np.full(size, 2166136261 + n, np.uint32)
            for k in range(n):
                value = (value ^ chars[k : k + size]) * np.uint32(16777619)
            keep = ~(gap[:size] & gap[n - 1 : n - 1 + size]) if n == 2 else np.ones(size, bool)
            for k in range(1, n - 1):
                keep &= ~gap[k : k + size]
            if n == 1:
                keep = ~gap[:size]
            yield ((value * np.uint32(2654435769)) >> shift)[keep]


@dataclass
class LanguageModel:
    """``table`` has the logits that a subword of each bucket adds, divided by the calibrated temperature."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    threshold: float
    orders: tuple[int, ...]
    buckets: int

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of the languages, a row for each text; rows of texts without letters are NaN."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for row, text in enumerate(texts):
            for ids in subwords(text or "", self.orders, self.buckets):
                total[row] += self.table[ids].sum(axis=0, dtype=np.float64)
                count[row] += len(ids)
        with np.errstate(invalid="ignore", divide="ignore"):
            return _softmax(total / count[:, None] + self.bias)

    def column(self, text: Column) -> Column:
        """struct(lang_pred, score, accepted) of a text column."""

        @F.pandas_udf("lang_pred string, score double, accepted boolean")
        def predict(texts: pd.Series) -> pd.DataFrame:
            p = self.scores(texts.tolist())
            none = np.isnan(p).any(axis=1)
            p[none] = 0.0
            best = p.argmax(axis=1)
            score = np.where(none, 0.0, p.max(axis=1))
            names = np.where(none, UNKNOWN, np.array(self.languages, dtype=object)[best])
            return pd.DataFrame({"lang_pred": names, "score": score, "accepted": ~none & (score >= self.threshold)})

        return predict(text)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    examples: DataFrame,
    max_documents: int = 3000,
    orders: tuple[int, ...] = (1, 2, 3, 4),
    buckets: int = 1 << 13,
    dim: int = 16,
    epochs: int = 12,
    rate: float = 0.4,
    reject: float = 0.002,
    precision: float = 0.995,
    seed: int = 7,
    few: int = 10_000,
) -> LanguageModel:
    """Fit on (doc_id, text, lang) rows, of which about ``max_documents`` are drawn: for each language an equal number, or
    all it has, by a hash of doc_id, so a rare language has its examples too.

    Workers turn each drawn text into bucket counts, once whole and once as a short passage, and the driver gets only
    those (at most 2 x ``max_documents`` sparse rows of ``buckets`` columns). The counts of languages are broadcast if there are ``few``. Stochastic gradient descent fits the
    embeddings and the softmax; a fifth of the rows, kept aside, sets the temperature and the score under which a
    prediction is rejected: 0.5, or as high as it takes for accepted ones to be right with ``precision``, but no more
    than ``reject`` of right predictions are ever rejected. Rows are in order of a hash of doc_id, so the fit hangs on
    no partitioning.
    """
    examples = examples.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = examples.groupBy(F.col("lang").alias("own")).agg(F.count(F.lit(1)).alias("n")).withColumn("each", F.lit(max_documents) / F.count(F.lit(1)).over(Window.partitionBy()))
    share = F.least(F.lit(1.0), F.col("each") / F.col("n")) * (1 << 30)
    if sizes.limit(few + 1).count() <= few:
        sizes = F.broadcast(sizes)
    chosen = examples.join(sizes, F.col("lang") == F.col("own")).where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < share)
    chosen = chosen.select(F.xxhash64("doc_id", F.lit(seed + 1)).alias("key"), "text", "lang")

    def counted(frames):
        for frame in frames:
            rows = []
            for key, text, lang in zip(frame["key"], frame["text"], frame["lang"]):
                words = text.split()
                at = len(text) % max(1, len(words) - 12)
                for passage in (text, " ".join(words[at : at + 12])):
                    bins = np.zeros(buckets, np.int64)
                    for ids in subwords(passage, orders, buckets):
                        bins += np.bincount(ids, minlength=buckets)
                    if bins.any():
                        used = np.nonzero(bins)[0]
                        rows.append((key, lang, used.astype("<u4").tobytes(), (bins[used] / bins.sum()).astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["key", "lang", "ids", "weights"])

    # Packed bytes, a row at a time: as lists of numbers the rows would take the driver several times the memory.
    keys, names, ids, weights = [], [], [], []
    for key, lang, own, share_of in chosen.mapInPandas(counted, "key long, lang string, ids binary, weights binary").toLocalIterator():
        keys.append((key, lang, bytes(own)))
        names.append(lang)
        ids.append(np.frombuffer(own, "<u4").astype(np.uint16 if buckets <= 1 << 16 else np.uint32))
        weights.append(np.frombuffer(share_of, "<f4"))
    in_order = sorted(range(len(keys)), key=keys.__getitem__)
    names, ids, weights = ([column[i] for i in in_order] for column in (names, ids, weights))
    del keys
    languages = sorted(set(names)) or [UNKNOWN]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(names))
    label = np.array([languages.index(x) for x in names], dtype=int)
    aside, fit = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        a = np.zeros((len(rows), buckets), np.float32)
        for i, r in enumerate(rows):
            a[i, ids[r]] = weights[r]
        return a

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(fit), 32):
            rows = fit[at : at + 32]
            a = dense(rows)
            x = a @ embed
            wrong = _softmax(x @ out + bias)
            wrong[np.arange(len(rows)), label[rows]] -= 1
            # Averages are small, so embeddings take larger steps than the softmax.
            slope = wrong @ out.T
            out -= step * 10 * (x.T @ wrong) / len(rows)
            bias -= step * 0.1 * wrong.mean(axis=0)
            embed -= step * 100 * (a.T @ slope) / len(rows)
    table = embed @ out
    logits = np.vstack([dense(aside[i : i + 64]) @ table + bias for i in range(0, len(aside), 64)] or [np.zeros((0, len(languages)))])
    heat, threshold = 1.0, 0.0
    if len(aside):
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(aside)), label[aside]] + 1e-12).mean()
        heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        p = _softmax(logits / heat)
        threshold = rejection(p.max(axis=1), p.argmax(axis=1) == label[aside], precision, reject)
    return LanguageModel(languages, (table / heat).astype(np.float32), bias / heat, threshold, orders, buckets)


def rejection(scores: np.ndarray, right: np.ndarray, precision: float, reject: float) -> float:
    """The score under which predictions are rejected (see ``train``)."""
    if not right.any():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    lowest = scores[order][np.flatnonzero(good)[-1]] if good.any() else 1.0
    if good[-1]:
        lowest = 0.0  # all of them are right often enough
    return float(min(np.quantile(scores[right], reject), max(0.5, lowest)))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus == remainder


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, accepted for each row of ``docs``: a null text or one without letters is ``und``, at
    score 0, and never accepted. Ties go to the first language in order; rows that repeat, and null ids, are rows like
    others; an empty table gives an empty one. Of ``docs`` only doc_id and text are read.
    """
    found = docs.select("doc_id", model.column(F.col("text").cast("string")).alias("found"))
    return found.select("doc_id", "found.*")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose language the model accepts, with their own columns. Null texts and those without letters go;
    rows that repeat, and those of a null doc_id, stay or go like others; an empty table gives an empty one.
    """
    return docs.where(model.column(F.col("text").cast("string"))["accepted"])


def train_on_documents(docs: DataFrame) -> LanguageModel:
    return train(docs.where(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_on_documents(docs)
    return identify_languages(docs, model).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "accepted"
    )
