"""The registered queries of the corpus operators. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitpack, bpe, licenses, mixing, neardup, packing, quality, repair, substring, tiff, topk, toxicity, variants


def vocabulary(name: str) -> str:
    """A public tokenizer's file; the operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(_read(spark, sf_dir, "documents"))


def op2_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.round_trip(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest(_read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=2)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(_read(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("matches")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_read(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(_read(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_bitpack": op2_bitpack,
    "op3_tiff": op3_tiff,
    "op4_topk": op4_topk,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_minhash": op8_minhash,
    "op9_substring": op9_substring,
    "op10_licenses": op10_licenses,
    "op11_variants": op11_variants,
    "op12_repair": op12_repair,
    "op13_bpe": op13_bpe,
}

SQL: dict[str, str] = {
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM scored QUALIFY rank <= 10
    """,
}
