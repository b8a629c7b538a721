"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import oracles
from gaugeline.llm.collocations import mine_collocations
from gaugeline.llm.common import table
from gaugeline.llm.html_extraction import extract_pages
from gaugeline.llm.language_id import identify
from gaugeline.llm.license_scan import license_scan
from gaugeline.llm.line_dedup import line_dedup
from gaugeline.llm.mixing import mixing_rates
from gaugeline.llm.ngram_jaccard import jaccard_classes
from gaugeline.llm.quality_rules import quality_rules
from gaugeline.llm.sentencepiece_sampling import encode_samples
from gaugeline.llm.spelling import variant_groups
from gaugeline.llm.substring_dedup import repeated_spans
from gaugeline.llm.topk_search import top_k
from gaugeline.llm.url_filters import judge_urls


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_samples(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return top_k(docs, docs.where("doc_id % 100 = 0"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), text=False)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_sentencepiece, op3_topk_search, op4_url_filters, op5_html_extraction, op6_quality_rules,
                            op7_language_id, op8_suffix_dedup, op9_ngram_jaccard, op10_mixing, op11_collocations, op12_spelling_variants,
                            op13_line_dedup)}
ORACLES: dict[str, str] = {"op11_collocations": oracles.OP11, "op12_spelling_variants": oracles.OP12, "op13_line_dedup": oracles.OP13}
