"""The thin queries over the operators, as registered for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm.byte_bpe import round_trip
from tarnwork.llm.common import table
from tarnwork.llm.language_id import fit as fit_languages
from tarnwork.llm.language_id import identify
from tarnwork.llm import hamming_topk, rp_forest
from tarnwork.llm.packing import pack_documents
from tarnwork.llm.quality_crf import fit as fit_quality
from tarnwork.llm.quality_crf import score as score_quality
from tarnwork.llm import suffix_dedup
from tarnwork.llm.html_text import extract as extract_html
from tarnwork.llm.weighted_minhash import near_duplicates
from tarnwork.llm.token_counts import token_counts


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json", capacity=2048, end_id=0)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"), width=100)


def op4_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), "byte_bpe_50k.tiktoken")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, words=5)


def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_topk.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=1024)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_approximate_neighbours": op4_approximate_neighbours,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_language_id": op6_language_id,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_hamming_topk": op8_hamming_topk,
    "op9_token_counts": op9_token_counts,
    "op10_html_extraction": op10_html_extraction,
}

_BITS = "[CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END FOR x IN embedding]"
ORACLES: dict[str, str] = {
    "op8_hamming_topk": f"""
        WITH codes AS (SELECT vec_id, {_BITS} AS bits FROM embeddings WHERE embedding IS NOT NULL),
        pairs AS (
            SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
                   CAST(list_sum([abs(p[1] - p[2]) FOR p IN list_zip(q.bits, r.bits)]) AS INTEGER) AS distance
            FROM codes q JOIN codes r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
        SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10""",
}
