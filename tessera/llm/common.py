"""Helpers shared by the corpus operators: row packing, staging, word rules and distributed ranks."""

from __future__ import annotations

import hashlib
import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of bytes other than the six ASCII blanks; the same text serves Java's and Python's regex.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where ``spark.checkpoint.dir`` is unset one is made, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tessera-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Staged folders that this process has not deleted yet; see ``clean``.
_STAGED: set[str] = set()


def staged_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.add(path)
    return path


def clean(spark: SparkSession) -> None:
    """Deletes all that the operators have staged in this process. Results of operators may read it: write them first."""
    for path in sorted(_STAGED):
        drop_path(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet below the shared folder and reads it again, which cuts the lineage."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a staged folder through Hadoop's file system, whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _STAGED.discard(path)


def drop_staged(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``stage`` that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            drop_path(df.sparkSession, path)


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """One struct ``_row`` with all input columns beside the operator's own columns, so that no input name can clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in named.items()])


def corpus_seeds(docs: DataFrame, n: int = 2) -> tuple[list[int], int]:
    """``n`` 64-bit seeds from a digest of all texts in any order, and the texts' bytes. One scan; two numbers come back."""
    part = lambda k: F.conv(F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), k, 15), 16, 10).cast("decimal(38,0)")
    row = docs.agg(F.sum(part(1)), F.sum(part(16)), F.sum(F.octet_length("text"))).first()
    digest = hashlib.sha512(f"{row[0]} {row[1]}".encode()).digest()
    return [int.from_bytes(digest[8 * k : 8 * k + 8], "little") for k in range(n)], int(row[2] or 0)


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_bits(rows: int, per_bucket: int = 500, most: int = 24) -> int:
    """How many leading hash bits split ``rows`` rows into buckets of about ``per_bucket``."""
    return max(1, min(most, math.ceil(math.log2(max(2.0, rows / per_bucket)))))


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, bits: int, ties: Sequence[str] = ()) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``keys`` that come before, ordered by the 64-bit hash ``order``.

    A key may hold any share of all rows. Its rows are cut into ``2**bits`` ranges of the hash; sums of ranges are
    pre-aggregated and accumulated, and only rows of one range of one key meet in a window.
    """
    parts = [f"_k{i}" for i in range(len(keys))] + [f"_null{i}" for i in range(len(keys))] + ["_range"]
    ranged = df.withColumn("_range", F.shiftright(F.col(order), 64 - bits)).withColumn("_value", value)
    for i, k in enumerate(keys):  # keys without nulls, so that the join and the window share one shuffle
        ranged = ranged.withColumn(f"_k{i}", F.coalesce(F.col(k).cast("string"), F.lit(""))).withColumn(f"_null{i}", F.col(k).isNull())
    by_key = Window.partitionBy(*parts[:-1], F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*parts).agg(F.sum("_value").alias("_sum"))
    sums = sums.select(*parts, F.coalesce(F.sum("_sum").over(by_key), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*parts).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(sums, parts)
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_value", "_base", *parts)
