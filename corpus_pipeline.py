"""The corpus pipeline: from raw documents to encoded training text.

1. The quality classifier scores documents; those it rejects go.
2. Quality rules with risk-controlled thresholds judge the rest; those they reject go.
3. SimHash near-duplicates: of each component the document with the least id stays.
4. Sources are mixed to target weights: documents are left out or repeated until each source has its budget of words.
5. Byte-level BPE encodes what is left; ids and the decoded bytes are digested.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Each stage handles what its operator's docstring states:
nulls in any column, empty and very long texts, repeated rows and empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, classifier, mixing, quality_rules, simhash
from tidemark.llm.common import shared_dir, table


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("simhash near-dedup", deduplicated),
    ("source mixing", mixed),
    ("byte bpe", encoded),
]

#: Trees, hashing of words and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Each stage's rows are written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(at := f"{folder}/{k}")
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
