"""From documents to a training mixture: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemark.llm.common import scratch_path, table
from tracemark.llm.decontaminate import decontaminate
from tracemark.llm.exact_dedup import exact_dedup
from tracemark.llm.jaccard_join import jaccard_dedup
from tracemark.llm.language_id import keep_identified
from tracemark.llm.mixing import mixture as mixed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified go on; texts that are null or without letters are rejected, and so are
    those whose score is below the operator's least one."""
    return keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id goes on."""
    return exact_dedup(docs).filter("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a Jaccard similarity of 0.8 of their five-word shingles the one with the
    smallest id goes on."""
    return jaccard_dedup(docs, words=5, threshold=(80, 100))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item go on."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), shortest=1)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each copy of a document, with its source's weight, its epoch and its place."""
    return mixed(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("decontaminate", benchmark_leaks),
    ("mixing", mixture),
]

# language identification by a trained model has no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
