"""The corpus pipeline: quality, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read
again as the next one's docs. All but the last return the columns of documents.

Nulls, empty and very long texts, ties, repeated rows and empty tables are defined by the operators;
extra columns of any name travel along to the mixing stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from engramic.llm import mixing, near_dedup, packing, passages, quality
from engramic.llm.common import Run, delete_paths, documents
from engramic.llm.queries import tokenizer_path
from engramic.scratch import delete_at_exit, scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of ``docs``."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (5-word Jaccard of 0.8 or more), the smallest doc_id.

    A SimHash radius that reaches such pairs finds chance pairs without number, so this stage of
    operator 1 collides MinHash bands and verifies the shingle sets: see the README."""
    return near_dedup.keep_one(docs)


def paragraph_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut out but in the first document that has them."""
    return passages.without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it."""
    return mixing.mixed_copies(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in tokens, in their batches."""
    return packing.packed_documents(docs, tokenizer_path())


#: The staged tables of the stages that this process runs, thread by thread.
_RUN = Run()


def _fresh(stage):
    """``stage`` after the tables that the stage before it staged are deleted: its result is written."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with _RUN.stage(spark):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    (stage.__name__, _fresh(stage))
    for stage in (quality_classifier, simhash_near_dedup, paragraph_dedup, source_mixing, length_packing)
]
#: A factorisation machine, components and dynamic programming are beyond SQL: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages. What they wrote on the way is deleted, the result at the end of the
    application."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        delete_paths(spark, before)
        before = [path]
    _RUN.clear(spark)
    delete_at_exit(spark, path)
    return docs
