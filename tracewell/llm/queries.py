"""The operators as queries over the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .common import read
from .decontaminate import contamination
from .language_id import language_digest
from .line_dedup import line_digest
from .minhash_forest import forest_duplicates
from .mixing import taken_words
from .ngram_join import near_duplicates
from .oracle import ORACLE
from .quality_model import quality_digest
from .quality_rules import rule_columns
from .secrets import secret_digest
from .token_counts import CountParams, edited_counts, masked_numbers
from .resampling import resampled
from .token_files import FileParams, token_digest


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_columns(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(read(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(read(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(spark, read(spark, sf_dir, "documents"), FileParams(tokenizer_path()))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return edited_counts(docs, masked_numbers(docs), CountParams(tokenizer_path()))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op12_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_duplicates(read(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_quality_classifier, op2_mix_sources, op3_quality_rules, op4_secret_scan, op5_language_id, op6_ngram_jaccard, op7_decontaminate, op8_line_dedup, op9_token_files, op10_token_counts, op11_collocations, op12_minhash_forest, op13_resample, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
