"""From raw documents to token ids in five stages, each working on all that the one before kept.

1. Quality rules: documents that break a rule go.
2. N-gram Jaccard join: of each component of near duplicates the row of least doc_id stays (rows without doc_id
   last; of equal ones the first row of the table).
3. Benchmark decontamination: documents that hold a benchmark item, also re-parameterised, go.
4. Secret scans: every reported span is replaced by a mark; the documents stay, their n_chars follows.
5. Byte-level BPE: doc_id, n_tokens, ids and whether decoding gives the text's bytes again (it must).

Rows are told apart by their place in the stage's table, so null and repeated doc_ids need no care. A null text is
an empty one; the quality rules drop it. Empty tables give empty tables. Extra columns pass through to stage 5.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lares.llm import bpe, decontaminate, jaccard_join, quality_rules, secret_scan
from lares.llm.tables import documents, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ROW = "_row_of_stage"


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the place of each row, and the new column's name: ROW, or one like it that docs doesn't have."""
    name, taken = ROW, {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def _without(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """docs (numbered by that column) without the rows of those numbers."""
    return docs.join(rows, name, "left_anti").drop(name)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(docs.select(F.struct(*docs.columns).alias("_document"), "text"))
    return judged.filter("kept").select("_document.*")


def apply_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered, row = _numbered(docs)
    found = settle(jaccard_join.near_duplicates(numbered, key=row).withColumnRenamed("doc_id", row))
    rows = found.join(numbered.select(row, "doc_id"), row)
    kept = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias("kept"))
    dropped = rows.join(kept, "component_id").filter(F.col(row) != F.col("kept")).select(row)
    return _without(numbered, settle(dropped), row)


def apply_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered, row = _numbered(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = decontaminate.leaks(numbered, benchmark, key=row).select(F.col("doc_id").alias(row)).distinct()
    return _without(numbered, settle(leaked), row)


def apply_secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def apply_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", apply_quality_rules),
    ("jaccard_join", apply_jaccard_join),
    ("decontaminate", apply_decontamination),
    ("secret_scan", apply_secret_scan),
    ("byte_bpe", apply_byte_bpe),
]

#: No stage but the first can be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = documents(spark, sf_dir)
    for _, stage in STAGES:
        table = settle(stage(spark, table, sf_dir))
    return table
