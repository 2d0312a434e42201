"""The registered queries of the text operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealcast.llm import (
    bpe,
    debruijn,
    decontamination,
    divergence,
    filter_audit,
    language,
    licences,
    mixing,
    oracles,
    quality,
    simhash,
    suffixes,
    toxicity,
    warc,
)
from arealcast.llm.common import table


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op2_rare_token_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("matches")


def op3_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_crf_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op5_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sparse_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.find_repeats(table(spark, sf_dir, "documents"))


def op8_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.drop("n_lines")


def op9_heap_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read_back(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op12_de_bruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_entropy_mix,
        op2_rare_token_licences,
        op3_pivot_simhash,
        op4_crf_languages,
        op5_minhash_containment,
        op6_compression_toxicity,
        op7_sparse_suffix_repeats,
        op8_risk_controlled_quality,
        op9_heap_bpe_counts,
        op10_warc_transactions,
        op11_filter_audit,
        op12_de_bruijn_repeats,
        op13_source_divergence,
    )
}
ORACLES: dict[str, str] = {
    "op10_warc_transactions": oracles.OP10_WARC,
    "op11_filter_audit": oracles.OP11_FILTER_AUDIT,
    "op12_de_bruijn_repeats": oracles.OP12_DE_BRUIJN_REPEATS,
    "op13_source_divergence": oracles.OP13_DIVERGENCE,
}
