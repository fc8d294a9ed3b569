"""The corpus pipeline: five operators, each working on all that the one before it kept.

An id need not be unique or set: rows of different texts that share an id, or have none, are documents of
their own, and a row goes only for its own text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import language_id, packing, quality_crf, suffix_dedup, weighted_minhash
from tarnwork.llm.common import table
from tarnwork.scratch import scratch

#: A document goes if its chance of good quality is below this.
QUALITY_FROM = 0.3
#: A document goes if its language is undetermined or less certain than this (noise, not mixed languages).
LANGUAGE_FROM = 0.02


def _keyed(docs: DataFrame, shared: bool) -> tuple[DataFrame, str]:
    """``docs`` and a column that keys them, in order of ids (null ids last), then of texts' hashes.

    That is doc_id itself where none is null (nor, if it is asked for, ``shared`` by rows), as nearly always; else a new column.
    """
    wrong = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1") if shared else docs.where("doc_id IS NULL")
    if wrong.isEmpty():
        return docs, "doc_id"
    key = "_row"
    while key in docs.columns:
        key += "_"
    return suffix_dedup.keyed(docs, key=key), key


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines a conditional random field finds good (learned from ``labels``)."""
    field = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    return quality_crf.keep(docs, field, QUALITY_FROM)


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; what has no letter or is like no language goes."""
    return language_id.keep(docs, language_id.fit(docs), LANGUAGE_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one with the least id (null ids last; if ids repeat, any one of the class)."""
    keyed, key = _keyed(docs, shared=True)
    classes = weighted_minhash.near_duplicates(keyed, threshold=0.8, words=5, id_col=key)
    firsts = classes.where(F.col(key) == F.col("class_id")).select(key)
    return keyed.join(firsts, key, "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that 100-byte strings starting earlier cover and code points that this splits (rows in order of ids, null ids last)."""
    keyed, key = _keyed(docs, shared=False)
    left = suffix_dedup.remove_repeats(keyed, width=100, id_col=key, whole=True)
    left = left.withColumn("kept_text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept").cast("string")))
    return left.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces, placed in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, "word_bpe_49k.json", capacity=2048, end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language id", language_identification),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the trained and the sequence operators; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{scratch(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
