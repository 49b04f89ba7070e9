"""Corpus pipeline: from ``documents`` to packed training sequences.

Every stage takes what its predecessor kept, written as Parquet and read again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.llm import cross_parsing, line_chunks, similar_texts, swap_packing, toxicity_pu
from scribelake.llm.common import bounded_batches
from scribelake.llm.queries import tokenizer
from scribelake.session import shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the model learns from ``labels`` and the stage's own documents."""
    bounded_batches(spark)
    return toxicity_pu.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and texts long enough to judge that fit no language the labelled documents show."""
    bounded_batches(spark)
    return cross_parsing.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from all texts but the first; every document stays, with the length of its new text."""
    out = line_chunks.deduplicated(docs, passages=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts at a similarity of 0.8 or more the document with the smallest id stays."""
    bounded_batches(spark)
    return similar_texts.representatives(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, placed in sequences of 1024 tokens."""
    bounded_batches(spark)
    return swap_packing.packed(docs, tokenizer("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: SQL cannot express the trained stages; tests compare each stage with its operator and a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
