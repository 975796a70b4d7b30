"""Corpus preparation: documents through the stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language_id, toxicity
from tessera.llm._common import documents, written
from tessera.llm.mixing import repeat_by_mix
from tessera.llm.ngram_join import keep_one_of_each
from tessera.llm.packing import pack_documents, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, scores under 0.7."""
    model = toxicity.train_on_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the language model tells with enough certainty."""
    return language_id.keep_identified(docs, language_id.train_on_documents(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8 or more."""
    return keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, as the mix of sources takes them."""
    return repeat_by_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two tokens with their ids, none across documents."""
    return pack_documents(docs, vocabulary(), vocabulary("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_identified),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained models and a tokenizer aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of what all stages keep.

    Toxicity measures a null text as an empty one; language rejects null texts and those without letters. Rows of a null
    doc_id are no copies of anything and take part in the mix; of rows that repeat a doc_id and its text all stay or go.
    Columns beside those of ``documents``, whatever their names, come along up to the last stage. Empty tables give an
    empty one.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
