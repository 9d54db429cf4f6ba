"""A corpus pipeline: language, near-duplicates, repeated passages, benchmarks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as
Parquet and read again before the next one starts, so a stage works on all that
its predecessor kept and a lost executor costs tasks, not stages. All but the last
stage keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.op2_decontamination import decontamination_stage
from tidegauge.llm.op3_bpe import digests, encode
from tidegauge.llm.op4_language import language_stage
from tidegauge.llm.op5_substrings import substring_stage
from tidegauge.llm.op7_simhash import near_duplicates_stage
from tidegauge.session import remove, remove_at_end, scratch, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates_stage(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination_stage(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(encode(docs))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The stages run a trained network and automata, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table.

    A stage's intermediate frames go when it is written, its output when the next
    stage is, and the last output when the application ends.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        remove_at_end(spark, path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
