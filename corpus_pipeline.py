"""A corpus pipeline of five stages: from raw documents to tokens of clean, different texts.

Each stage works on all rows that the one before kept, is written as Parquet to the shared folder and read again, so a
lost executor repeats part of one stage only. Null and empty texts pass through the stages as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm import bpe, decontaminate, jaccard, line_dedup, mil
from skerry.llm.frames import settle, table
from skerry.llm.queries import tokenizer_path

#: No stage can be said in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, accepts."""
    return mil.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines out; a document that consists of lines kept elsewhere goes with them."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left."""
    return bpe.encoded(docs, tokenizer_path())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
