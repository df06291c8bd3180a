"""Corpus pipeline: language ID, quality, near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. The
first four return the columns of ``documents``; the last returns where each document is packed.

Edge cases, the same in every stage: rows count by themselves, so null and repeated ids lose nothing but what the
stage rejects in that row; very long texts are read whole; an empty table gives an empty table with the stage's
columns; further columns, whatever their names, are carried along by the first four stages and dropped by the last.
Null texts and texts without a letter are rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontam, jaccard, langid, packing, quality, shared
from lattica.llm.queries import fold, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters of which at least half is in one known language; without a language to learn from, none. Ties between
    languages go to the first by name; repeated rows are kept or rejected alike."""
    return langid.accept(docs, langid.train(docs.filter(fold(5) != 0)))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; without trusted positives it can't tell and accepts all (a score of 0.5). A null text
    is scored like an empty one; equal texts are accepted or rejected alike."""
    described = shared.table(spark, quality.features(docs.filter(fold(3) != 1), ["doc_id"]), "described")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(fold(3) != 1)
    return quality.accept(docs, quality.train(described, labels))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, of equal ids the first row, rows without an id last.
    Texts without words are near nothing; only rows that repeat both id and such a text are one."""
    return jaccard.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; a null text has none, an empty benchmark rejects nothing."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_size, batch_id, place and padding of every document; a null text is its end id alone."""
    sized = shared.table(spark, packing.lengths(docs, ["doc_id"], tokenizer_path()), "lengths")
    return packing.pack(sized, packing.plan(sized))


STAGES = [("language ID", language), ("quality classifier", good), ("n-gram Jaccard join", unlike), ("benchmark decontamination", unseen), ("packing", packed)]

#: Language models, classifiers and tokenizers have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.table(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
