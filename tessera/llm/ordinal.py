"""Cumulative-link (proportional odds) regression of graded ratings on hashed features of whole texts.

P(grade > k) = logistic(w.x - t_k) with one weight per hashed feature, shared by all grades, and ordered thresholds
t_1 < t_2 < ...; the sum of these tails is the expected grade. The model is fitted on a bounded sample of rated
documents (``SAMPLE``, those whose ids have the least hashes): the features that go with the grade are picked by a
grouped query over the sample, and only these few come to the driver. Scoring is a pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import stage
from .words import MARKS, mix, portions, raw, spans, word_hashes

#: Rated documents that a model is fitted on, at most.
SAMPLE = 20_000
#: Features kept, least number of documents that hold one, and least association with the grade in standard deviations.
FEATURES, LEAST_DOCS, LEAST_Z = 2048, 3, 4.0
BUCKET_BITS = 22
SEED = 29

_U = np.uint64
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91] = 65
_KIND[97:123] = 97
_KIND[48:58] = 48
_KIND[128:] = 97


def _shapes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' shapes: letters by case, digits, and marks as they are, with runs of a kind made one."""
    data, offsets = raw(column)
    kind = _KIND[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    starts, _, _ = spans(data, offsets)
    keep[starts] = True
    kept = np.r_[0, np.cumsum(keep)][offsets]
    array = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(kept.astype(np.int64).tobytes()), pa.py_buffer(kind[keep].tobytes())])
    return word_hashes(array)


def _parts(column: pa.Array, kinds: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the features of each kind, and where each document's begin."""
    words = None
    for k, kind in enumerate(kinds):
        if kind == "shapes":
            hashes, first = _shapes(column)
        elif kind == "tokens":  # words without their marks
            hashes, first = word_hashes(column, lower=True, blank=MARKS)
        else:
            if words is None:
                words = word_hashes(column, lower=True)
            hashes, first = words
            if kind == "repeats":  # one feature: a word that repeats the one before it
                same = np.r_[False, hashes[1:] == hashes[:-1]] if len(hashes) else np.zeros(0, bool)
                same[first[:-1][first[:-1] < len(hashes)]] = False  # a text's first word has none before it
                hashes = np.where(same, _U(1), _U(0))
        yield (mix(hashes + _U(k + 1 << 32)) >> _U(64 - BUCKET_BITS)).astype(np.int64), first


def features(column: pa.Array, kinds: Sequence[str], presence: bool, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and value of each feature of a batch: 1 for each that is present, or the root of its share of the words.

    Only buckets that ``wanted`` marks are returned, if it is given.
    """
    docs, buckets, values = [], [], []
    for found, first in _parts(column, kinds):
        counts = np.diff(first)
        doc = np.repeat(np.arange(len(counts)), counts)
        if wanted is not None:
            keep = wanted[found]
            doc, found = doc[keep], found[keep]
        keys, times = np.unique(doc << BUCKET_BITS | found, return_counts=True)
        doc = keys >> BUCKET_BITS
        docs.append(doc)
        buckets.append(keys & ((1 << BUCKET_BITS) - 1))
        values.append(np.ones(len(keys)) if presence else np.sqrt(times / counts[doc]))
    return np.concatenate(docs), np.concatenate(buckets), np.concatenate(values)


def _portions(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a bounded number of bytes of their column ``text``."""
    for batch in batches:
        for low, count in portions(batch.column(text)):
            yield batch.slice(low, count)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class Model:
    """Weights by bucket, ordered thresholds, and the features they stand on."""

    kinds: tuple[str, ...]
    presence: bool
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        wanted, weight = np.zeros(1 << BUCKET_BITS, bool), np.zeros(1 << BUCKET_BITS)
        wanted[self.buckets], weight[self.buckets] = True, self.weights
        return wanted, weight

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return _logistic(score[:, None] - self.thresholds[None, :])


def fit(doc: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_columns: int, grades: int, penalty: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model with a squared penalty, by full-batch adaptive steps.

    The thresholds are the first one and the logarithms of the gaps, so their order holds throughout.
    """
    n = max(1, len(grade))
    share = np.clip([(grade > k).mean() if len(grade) else 0.5 for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    params = np.r_[np.zeros(n_columns), start[:1], np.log(np.maximum(np.diff(start), 1e-3))]
    mean, square = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(len(grade))
    for step in range(1, steps + 1):
        w, gaps = params[:n_columns], np.exp(np.clip(params[n_columns + 1 :], -20, 5))
        thresholds = params[n_columns] + np.r_[0, np.cumsum(gaps)]
        score = np.bincount(doc, value * w[column], minlength=len(grade))
        tail = np.c_[np.ones(len(grade)), _logistic(score[:, None] - thresholds[None, :]), np.zeros(len(grade))]
        slope = np.c_[np.zeros(len(grade)), tail[:, 1:-1] * (1 - tail[:, 1:-1]), np.zeros(len(grade))]
        likely = np.maximum(tail[rows, grade] - tail[rows, grade + 1], 1e-12)
        up, down = slope[rows, grade] / likely / n, slope[rows, grade + 1] / likely / n  # by the threshold below and above
        by_score = -(up - down)
        by_threshold = np.bincount(grade, up, minlength=grades)[1:] - np.bincount(grade, down, minlength=grades)[:-1]
        grad = np.r_[np.bincount(column, value * by_score[doc], minlength=n_columns) + penalty * w, by_threshold.sum(), np.cumsum(by_threshold[::-1])[::-1][1:] * gaps]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        params = params - 0.1 * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return params[:n_columns], params[n_columns] + np.r_[0, np.cumsum(np.exp(np.clip(params[n_columns + 1 :], -20, 5)))]


def _statistics(batches: Iterator[pa.RecordBatch], kinds: Sequence[str], presence: bool) -> Iterator[pa.RecordBatch]:
    """For each bucket, the documents that hold it and the sum of their grades."""
    for batch in _portions(batches, 1):
        grade = batch.column(0).to_numpy()
        doc, bucket, _ = features(batch.column(1), kinds, presence)
        some, where = np.unique(bucket, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.bincount(where, minlength=len(some)).astype(np.int64)), pa.array(np.bincount(where, grade[doc].astype(float), minlength=len(some)))], names=["bucket", "n", "total"])


def _picked(batches: Iterator[pa.RecordBatch], kinds: Sequence[str], presence: bool, buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    wanted = np.zeros(1 << BUCKET_BITS, bool)
    wanted[buckets] = True
    for batch in _portions(batches, 1):
        doc, bucket, value = features(batch.column(1), kinds, presence, wanted)
        order = np.argsort(doc, kind="stable")
        at = np.r_[0, np.cumsum(np.bincount(doc, minlength=batch.num_rows))].astype(np.int32)
        lists = [pa.ListArray.from_arrays(at, pa.array(x[order])) for x in (np.searchsorted(buckets, bucket), value)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["grade", "columns", "values"])


def train(docs: DataFrame, labels: DataFrame, grade: str, kinds: Sequence[str], presence: bool, sample: int = SAMPLE) -> Model | None:
    """A model of ``labels``' column ``grade`` (integers from 0; null: not rated), or None without two grades."""
    rated = labels.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(grade).cast("int").alias("grade"))
    rated = rated.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    held = stage(texts.join(F.broadcast(rated), "doc_id").select(F.greatest("grade", F.lit(0)).alias("grade"), "text"), "rated")
    n, mean, square, top = held.agg(F.count(F.lit(1)), F.avg("grade"), F.avg(F.col("grade") * F.col("grade")), F.max("grade")).first()
    spread = (square or 0.0) - (mean or 0.0) ** 2
    if not n or spread <= 0:
        return None
    stats = held.mapInArrow(lambda b: _statistics(b, kinds, presence), "bucket long, n long, total double").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    z = F.abs(F.col("total") - F.col("n") * F.lit(mean)) / F.sqrt(F.col("n") * F.greatest(F.lit(1.0) - F.col("n") / n, F.lit(1.0 / n)) * F.lit(spread))
    least = min(LEAST_DOCS, max(2, n // 50))
    best = stats.where(F.col("n") >= least).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(FEATURES).select("bucket").collect()
    buckets = np.array(sorted(r.bucket for r in best), np.int64)
    rows = held.mapInArrow(lambda b: _picked(b, kinds, presence, buckets), "grade int, columns array<long>, values array<double>").toArrow()  # at most ``sample`` rows
    columns, values = rows.column("columns").combine_chunks(), rows.column("values").combine_chunks()
    sizes = np.diff(columns.offsets.to_numpy())
    doc = np.repeat(np.arange(len(sizes)), sizes)
    weights, thresholds = fit(doc, columns.flatten().to_numpy(), values.flatten().to_numpy(), rows.column("grade").to_numpy(), len(buckets), int(top) + 1)
    return Model(tuple(kinds), presence, buckets, weights, thresholds)


def _tails(texts: pa.Array, model: Model, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """P(grade > k) of each text, for each k."""
    wanted, weight = table
    doc, bucket, value = features(texts, model.kinds, model.presence, wanted)
    return model.tails(np.bincount(doc, value * weight[bucket], minlength=len(texts)))


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    table = model.table()
    for part in _portions(batches, 1):
        tails = _tails(part.column(1), model, table)
        lists = pa.ListArray.from_arrays(np.arange(0, tails.size + 1, tails.shape[1]).astype(np.int32), pa.array(tails.reshape(-1)))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tails.sum(axis=1)), lists], names=["_row", "expected", "tails"])


def score(docs: DataFrame, model: Model | None, row_columns: Sequence[str]) -> DataFrame:
    """``_row`` (the named columns), expected grade and tails P(grade > k) of each row. Null text counts as empty.

    Texts of any length are read whole. Without a model (no ratings, or all alike) both are null.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in row_columns]).alias("_row")
    if model is None:
        return docs.select(row, F.lit(None).cast("double").alias("expected"), F.lit(None).cast("array<double>").alias("tails"))
    rows = docs.select(row, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([rows.schema["_row"], StructField("expected", DoubleType()), StructField("tails", ArrayType(DoubleType()))])
    return rows.mapInArrow(lambda b: _scores(b, held.value), schema)


def reaching(docs: DataFrame, model: Model | None, grade: int, least: float) -> DataFrame:
    """The rows, with all their columns, whose P(grade >= ``grade``) is at least ``least``; all rows without a model.

    A grade beyond the model's is reached with probability 0, one of 0 or less with 1.
    """
    if model is None or grade <= 0:
        return docs
    held, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value.table()
        for part in _portions(batches, text):
            tails = _tails(part.column(text), held.value, table)
            yield part.filter(pa.array(tails[:, grade - 1] >= least if grade <= tails.shape[1] else np.full(len(tails), 0.0 >= least)))

    return docs.mapInArrow(kept, docs.schema)
