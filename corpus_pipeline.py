"""Corpus preparation: STAGES in order, each written as Parquet and read again by the next.

language ID → line dedup → n-gram Jaccard join → source mix → byte-level BPE.
All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import bpe, jaccard, langid, lines, mixing
from spectraloom.llm.common import bucket_of, read, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier accepts; it learns from the stage's own documents outside the held-out quarter.

    A text that is null or has no letters has no language and goes, too.
    """
    model = langid.fit(docs.filter(bucket_of("doc_id", 4) != 2))
    return langid.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines, and documents that lose all of theirs."""
    return lines.without_repeated_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies; one without an id is in no group and stays."""
    classes, _ = jaccard.join(docs)
    copies = classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("__copy_id")).distinct()
    return docs.join(copies, F.col("doc_id") == F.col("__copy_id"), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one without words is never taken."""
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of each row."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: SQL expresses neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
