"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftline.llm import alignment, ann, bpe, media, mixing, packing, pii, sharding, simhash, toxicity, urls, whitening
from driftline.llm.common import table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, full=False)


def op10_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payloads(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_MODEL, full=False)


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op13_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivotal_mixing": op1_pivotal_mixing,
    "op2_pii_spans": op2_pii_spans,
    "op3_simhash_near_duplicates": op3_simhash_near_duplicates,
    "op4_toxicity": op4_toxicity,
    "op5_packed_ids": op5_packed_ids,
    "op6_nearest_vectors": op6_nearest_vectors,
    "op7_url_filters": op7_url_filters,
    "op8_token_counts": op8_token_counts,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_media_chunks": op10_media_chunks,
    "op11_token_alignment": op11_token_alignment,
    "op12_feistel_shards": op12_feistel_shards,
    "op13_lobpcg_whitening": op13_lobpcg_whitening,
}
SQL: dict[str, str] = {}
