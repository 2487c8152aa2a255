"""A corpus in five stages, each written and read again by whoever runs them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ringtide.llm import bpe, language, mixing, neardup, quality
from ringtide.llm.common import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the certified cutoffs keep."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told."""
    return language.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of every class of near-duplicates."""
    return neardup.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, and their `position` in the order in which their sources take turns. A column of that name gives way to it."""
    return mixing.mix(docs.drop("position"), position="position")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, as hashes, beside the hash of the text that they decode to; in the mixed order."""
    return bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"), order_col="position")


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("BPE", bpe_stage),
]

#: The models of the stages cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), compression="zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
