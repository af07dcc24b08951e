"""The corpus pipeline: quality, near-duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last keep the columns of documents. Null and
empty texts pass the first four stages as they are rated (a text without words is never served by the mixture), a null
doc_id is kept apart, repeated rows are documents of their own, texts of any length are read whole, and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, neardup, packing, quality, substring
from tessera.llm.common import drop_staged, stage
from tessera.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the ratings at hand, rejects go."""
    return quality.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by five-word shingles at 0.8 or more, the one of the smallest id stays."""
    return neardup.keep_one(docs)


def first_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that stand in passages which an earlier document holds."""
    return substring.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are served by weight, in whole documents; one served more than once appears as often."""
    return mixing.mixed_documents(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of training windows."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("substring dedup", first_passages),
    ("mixing", mixture),
    ("packing", windows),
]

#: The classifier and the shuffle of the mixture cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            before, docs = docs, stage(out, "pipeline")
            if k:
                drop_staged(before)
        else:
            docs = out
    return docs
