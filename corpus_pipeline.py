"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of documents (the last one too, a row for each copy).
Part of subpackage llm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontam, lines, minhash, mixing, quality
from glyphmill.session import table
from glyphmill.storage import scratch_root


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that stand earlier in the corpus."""
    return lines.drop_repeated(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(docs)


STAGES = [("quality", good), ("lines", unrepeated), ("near_duplicates", distinct), ("decontamination", clean), ("mix", mixed)]

#: SQL can't say expectation-maximisation, rolling hashes or Newton iterations; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/glyphmill/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
