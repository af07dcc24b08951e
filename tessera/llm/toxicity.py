"""Toxicity: ordinal regression of severity grades on the presence of hashed words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordinal

KINDS = ("tokens",)
#: Least probability of a severity of ``LEAST_GRADE`` or more for a document to count as toxic.
LEAST_TAIL = 0.3
LEAST_GRADE = 1


def model(docs: DataFrame, labels: DataFrame, sample: int = ordinal.SAMPLE) -> ordinal.Model | None:
    return ordinal.train(docs, labels, "toxic", KINDS, presence=True, sample=sample)


def rated(docs: DataFrame, labels: DataFrame, least_grade: int = LEAST_GRADE, least_tail: float = LEAST_TAIL) -> DataFrame:
    """doc_id, expected_severity, p_toxic = P(severity >= least_grade) and toxic of each row.

    Null and empty texts are rated by the thresholds alone. Without ratings, or if all are alike, numbers are null and
    no row is toxic. Repeated rows are rated alike; a null doc_id is scored but has no rating.
    Texts of any length are read whole; extra columns are not looked at; an empty table gives an empty result.
    """
    scored = ordinal.score(docs, model(docs, labels), ["doc_id"])
    tail = F.coalesce(F.get("tails", F.lit(least_grade - 1)), F.when(F.col("tails").isNotNull(), 0.0))  # no document reaches a grade beyond the rated ones
    return scored.select("_row.doc_id", F.col("expected").alias("expected_severity"), tail.alias("p_toxic"), F.coalesce(tail >= least_tail, F.lit(False)).alias("toxic"))
