"""The registered queries of the operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from lares.llm import bpe, decontaminate, forest_search, jaccard_join, lexical_search, lm_bloom, oracle, periodic_runs, quality_fm, quality_rules, secret_scan, sharding, suffix_dedup, token_counts
from lares.llm.tables import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_fm.score(docs, quality_fm.fit(docs, labels))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), shards=8)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.score(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.scan(documents(spark, sf_dir)))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.with_limit(token_counts.token_counts(documents(spark, sf_dir), path), 4096)


def op11_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return forest_search.neighbours(vectors, F.col("vec_id") % 20 == 0, k=20)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_quality_fm": op3_quality_fm,
        "op4_sharding": op4_sharding,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_lm_scores": op6_lm_scores,
        "op7_quality_rules": op7_quality_rules,
        "op8_secret_scan": op8_secret_scan,
        "op9_bpe_round_trip": op9_bpe_round_trip,
        "op10_token_counts": op10_token_counts,
        "op11_forest_search": op11_forest_search,
        "op12_lexical_search": op12_lexical_search,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": oracle.JACCARD_JOIN,
        "op7_quality_rules": oracle.QUALITY_RULES,
        "op12_lexical_search": oracle.LEXICAL_SEARCH,
    }
