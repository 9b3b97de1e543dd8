"""From raw documents to token files: quality, near-duplicates, benchmark passages, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the
last one returns a row per document written. Between stages the rows are stored below the shared
folder. No stage is expressible in SQL as a whole (trained scores, fingerprints), so ORACLE_SQL is
None and tests compare the stages with brute force.

A document that holds a benchmark window is dropped. The mix repeats or leaves out documents by
their source's weight; the document at the cut of a source keeps its leading words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemart.llm import decontaminate, mixing, quality, simhash, token_files
from tidemart.llm.common import table, written

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality_stage), ("simhash_near_dedup", near_duplicate_stage),
          ("benchmark_decontamination", decontamination_stage), ("source_mixing", mixing_stage),
          ("token_files", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = written(stage(spark, rows, sf_dir), name)
    return rows
