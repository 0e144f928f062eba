"""A corpus from raw documents: five stages, each calling one operator of ``veritally.llm``.

Every stage works on all rows that the one before it kept. Stages 1 to 4 return the columns of ``documents``, and any further ones; the last returns the mix. Each stage takes any row: nulls in
any column, empty and very long texts, ties, repeated rows and ids, extra columns of whatever name, and an empty table (which stays empty). What it then does stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritally.llm.common import written
from veritally.llm.decontaminate import without_leaks
from veritally.llm.mixing import mix_sources
from veritally.llm.ngram_join import one_of_each
from veritally.llm.quality import keep_good
from veritally.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and those without words (null or empty texts). Documents at the last place tie and stay together; rows that repeat a doc_id, or have none, are judged each by its text."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id. Documents without text, and rows without a doc_id, stay; rows that repeat a doc_id stay or go together."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; those without text stay. Items without text match nothing. Rows that repeat a doc_id, or have none, stay or go together."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind, row by row; null and empty texts stay as they are."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: a row per row; of documents without text 0. A null source is a source. Repeated doc_ids are taken in the order of their sizes."""
    return mix_sources(docs)


STAGES = [("quality classifier", quality), ("n-gram jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("mixing sources", mixing)]

#: The quality models are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
