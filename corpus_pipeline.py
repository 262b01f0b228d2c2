"""From raw documents to token files in five stages. Each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import read, recorded, release, shared_dir
from tracewell.llm.decontaminate import clean_documents
from tracewell.llm.mixing import mixed_documents
from tracewell.llm.ngram_join import one_of_each
from tracewell.llm.quality_model import accepted
from tracewell.llm.queries import tokenizer_path
from tracewell.llm.token_files import FileParams, token_digest


#: Folders of the tables that the stage in progress made. The next stage deletes them: by then its input is stored.
_tables: list[str] = []


def _stage(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    release(spark, _tables)
    with recorded(_tables):
        return make()


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return _stage(spark, lambda: accepted(docs, read(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return _stage(spark, lambda: one_of_each(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return _stage(spark, lambda: clean_documents(docs, read(spark, sf_dir, "benchmark")))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a row for each document and pass, with the words that the pass takes."""
    return _stage(spark, lambda: mixed_documents(docs))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written and read again: doc_id, start, n_tokens, ids_crc32."""
    return _stage(spark, lambda: token_digest(spark, docs, FileParams(tokenizer_path())))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("token-ID / binary output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_dir(spark, "pipeline")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


#: The draws, the classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
