"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roomledger.llm import (
    bpe, bytebpe, decontam, extract, langid, prefixtrie, quality, repeats, secretscan, simhash, tokencount, warc, whitening,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), TOKENIZER)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_predictions(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(_table(spark, sf_dir, "pages"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_documents(_table(spark, sf_dir, "documents"), TOKENIZER)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_spans(_table(spark, sf_dir, "documents"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encoded_documents(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefixtrie.turn_lists(_table(spark, sf_dir, "conversations"))
    return prefixtrie.prefix_trie(prefixtrie.branched(lists))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_language_id, op3_html_extraction, op4_bpe_round_trip, op5_secret_scan,
        op6_warc_round_trip, op7_quality_rules, op8_simhash_dedup, op9_repeated_strings, op10_decontamination, op11_prefix_bpe,
        op12_whitening, op13_prefix_trie,
    )
}
