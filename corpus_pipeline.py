"""Cleaning pipeline over ``documents``: five stages, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm.common import materialize, table
from gaugeline.llm.mixing import mix
from gaugeline.llm.ngram_jaccard import keep_representatives
from gaugeline.llm.quality_rules import keep_quality
from gaugeline.llm.sentencepiece_sampling import encode_samples
from gaugeline.llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, table(spark, sf_dir, "labels"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_samples(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard", near_duplicates), ("suffix_dedup", passages),
          ("mixing", mixing), ("sentencepiece", encoding)]

# Iterated estimates and sampling are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
