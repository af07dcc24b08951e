"""Quality: ordinal regression of graded ratings on hashed words, word shapes and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordinal

KINDS = ("shapes", "repeats", "words")
#: Least probability of a grade of ``LEAST_GRADE`` or more for a document to stay.
LEAST_TAIL = 0.5
LEAST_GRADE = 1


def model(docs: DataFrame, labels: DataFrame, sample: int = ordinal.SAMPLE) -> ordinal.Model | None:
    return ordinal.train(docs, labels, "quality", KINDS, presence=False, sample=sample)


def rated(docs: DataFrame, labels: DataFrame, least_grade: int = LEAST_GRADE, least_tail: float = LEAST_TAIL) -> DataFrame:
    """doc_id, expected_grade, p_good = P(grade >= least_grade) and kept of each row.

    Null and empty texts are rated by the thresholds alone. Without ratings, or if all are alike, numbers are null and
    every row is kept. Repeated rows are rated alike; a null doc_id is scored but has no rating.
    Texts of any length are read whole; extra columns are not looked at; an empty table gives an empty result.
    """
    scored = ordinal.score(docs, model(docs, labels), ["doc_id"])
    tail = F.coalesce(F.get("tails", F.lit(least_grade - 1)), F.when(F.col("tails").isNotNull(), 0.0))  # no document reaches a grade beyond the rated ones
    return scored.select("_row.doc_id", F.col("expected").alias("expected_grade"), tail.alias("p_good"), F.coalesce(tail >= least_tail, F.lit(True)).alias("kept"))


def select(docs: DataFrame, labels: DataFrame, least_grade: int = LEAST_GRADE, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The documents that stay, with all their columns; what ``rated`` says of nulls, empty texts and ratings holds."""
    return ordinal.reaching(docs, model(docs, labels), least_grade, least_tail)
