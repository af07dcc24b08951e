"""Exact top-k search by inner product over integer vectors.

Candidates are grouped by falling length. All vectors are turned into the axes of their own second moments (the right
singular vectors of the table), so that a few leading axes hold most of an inner product. The longest candidates give
each query a first threshold. A group is left out for a query whose length times the group's largest length stays below
it; within a group, the sum over the leading axes plus the product of the lengths of what is left (Cauchy-Schwarz) bounds
each score, and only pairs whose bound reaches the threshold are counted, exactly, in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import drop_staged, stage

SCALE = 1024
LEADING = 16
#: Longest candidates that give the first thresholds; candidates and queries that meet in one task.
SEEDS = 2048
GROUP = 16_384
QUERIES = 8_192
MOST_AXES = 4096


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double; null for a vector that is null or holds null, NaN or infinity."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.Array | pa.ChunkedArray, axes: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), axes), np.int64)
    out[np.arange(axes) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _moments(batches: Iterator[pa.RecordBatch], axes: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((axes, axes))
    for batch in batches:
        x = _matrix(batch.column(0), axes).astype(np.float64)
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(m.as_py()) for m in table.column("m"))
    return pa.table({"m": pa.array([total.tobytes()], pa.binary())})


def rotation(vectors: DataFrame, axes: int) -> np.ndarray:
    """Columns: the table's right singular vectors, most weight first. Partial sums meet in 32 tasks, then here."""
    parts = vectors.select("vector").mapInArrow(lambda b: _moments(b, axes), "m binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    merged = parts.groupBy("part").applyInArrow(lambda t: _add(t), "m binary").collect()
    total = sum((np.frombuffer(r.m) for r in merged), np.zeros(axes * axes)).reshape(axes, axes)
    _, turn = np.linalg.eigh((total + total.T) / 2)
    return np.ascontiguousarray(turn[:, ::-1])


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: by doubles where these are exact, else in 64-bit integers, else in Python's and cut to 64 bits."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2.0**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if top < 2.0**62:
        return q @ c.T
    exact = q.astype(object) @ c.T.astype(object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(query: np.ndarray, ident: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to smaller ids."""
    order = np.lexsort((ident, np.negative(np.maximum(score, -(1 << 63) + 1)), query))
    q = query[order]
    head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(head, np.diff(np.r_[head, len(q)]))
    return order[rank < k]


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, turn: np.ndarray, floor: np.ndarray, leading: int = LEADING) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best candidates other than itself, as places of queries, candidate ids and scores.

    ``floor`` is a score that each query's k-th best is known to reach, or minus infinity.
    """
    length = np.linalg.norm(c.astype(np.float64), axis=1)
    order = np.argsort(-length, kind="stable")
    c, c_ids, length = c[order], c_ids[order], length[order]
    qt, ct = q @ turn, c @ turn
    q_rest, c_rest = np.linalg.norm(qt[:, leading:], axis=1), np.linalg.norm(ct[:, leading:], axis=1)
    q_len = np.linalg.norm(q.astype(np.float64), axis=1)
    floor = floor.copy()
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for low in range(0, len(c), 1024):
        part = slice(low, low + 1024)
        slack = 1e-9 * (1 + q_len * length[low])
        live = np.flatnonzero(q_len * length[low] + slack >= floor)
        if not len(live):
            break
        for at in range(0, len(live), 512):
            some = live[at : at + 512]
            bound = qt[some, :leading] @ ct[part, :leading].T + q_rest[some, None] * c_rest[None, part] + slack[some, None]
            hit = (bound >= floor[some, None]) & (q_ids[some, None] != c_ids[None, part])
            rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
            if not len(rows):
                continue
            exact = products(q[some[rows]], c[part][cols])
            i, j = np.nonzero(hit[np.ix_(rows, cols)] & (exact >= floor[some[rows], None]))
            mine = np.concatenate([held[0], some[rows[i]]]), np.concatenate([held[1], c_ids[part][cols[j]]]), np.concatenate([held[2], exact[i, j]])
            keep = _best(*mine, k)
            held = tuple(x[keep] for x in mine)
            count = np.bincount(held[0], minlength=len(q))
            worst = np.full(len(q), np.iinfo(np.int64).max)
            np.minimum.at(worst, held[0], held[2])
            floor = np.where(count >= k, np.maximum(floor, worst.astype(np.float64)), floor)
    return held


def _cell(queries: pa.Table, candidates: pa.Table, k: int, turn: np.ndarray) -> pa.Table:
    if not queries.num_rows or not candidates.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
    ids, axes = queries.column("id").to_numpy(), len(turn)
    at, found, score = search(ids, _matrix(queries.column("vector"), axes), candidates.column("id").to_numpy(), _matrix(candidates.column("vector"), axes), k, turn, queries.column("floor").to_numpy())
    return pa.table({"query_id": ids[at], "vec_id": found, "score": score})


def _floors(batches: Iterator[pa.RecordBatch], k: int, axes: int, seeds) -> Iterator[pa.RecordBatch]:
    """Adds to each query its k-th best score among the longest candidates and the length that a rival must have."""
    ids, vectors = seeds.value
    for batch in batches:
        q = _matrix(batch.column("vector"), axes)
        scores = products(q, vectors).astype(np.float64)
        scores[batch.column("id").to_numpy()[:, None] == ids[None, :]] = -np.inf
        floor = np.sort(scores, axis=1)[:, -k] if len(ids) >= k else np.full(len(q), -np.inf)
        length = np.linalg.norm(q.astype(np.float64), axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(floor > 0, floor / length * (1 - 1e-9), 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor), pa.array(np.nan_to_num(reach, nan=0.0))], names=[*batch.schema.names, "floor", "reach"])


def _dealt(batches: Iterator[pa.RecordBatch], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds each vector's group: the number of edges (lengths, negative, in order) before it; ties are dealt by the id."""
    for batch in batches:
        length = -batch.column(batch.schema.names.index("length")).to_numpy()
        low, high = np.searchsorted(edges, length, "left"), np.searchsorted(edges, length, "right")
        turn = batch.column(batch.schema.names.index("id")).to_numpy() % (high - low + 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((low + turn).astype(np.int32))], names=[*batch.schema.names, "grp"])


def _visits(batches: Iterator[pa.RecordBatch], most: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds how many groups, from the longest on, hold a vector of the length that a query's rival must have, and the query's block."""
    for batch in batches:
        reach = batch.column(batch.schema.names.index("reach")).to_numpy()
        visits = np.searchsorted(-most * (1 + 1e-9), -reach, "right")
        low, high = np.searchsorted(parts, reach, "left"), np.searchsorted(parts, reach, "right")
        block = low + batch.column(batch.schema.names.index("id")).to_numpy() // 100 % (high - low + 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits.astype(np.int32)), pa.array(block.astype(np.int32))], names=[*batch.schema.names, "visits", "block"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows of ``vectors`` with another id; all, if fewer.

    Ties go to smaller ids. Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part; shorter vectors are filled up with zeros. Rows that repeat an id are candidates of their own; queries that
    repeat one count once, by their least vector. Scores beyond 64 bits are cut to them. An empty table gives an empty result.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(f"`{key}`").cast("long").alias("id"), integers(F.col(f"`{column}`"), scale).alias("vector")).where("id is not null and vector is not null")

    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    every = stage(usable(vectors).withColumn("length", F.sqrt(length)), "vectors")
    asked = usable(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    count, axes = every.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    axes = max(1, axes, asked.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0])
    if axes > MOST_AXES:
        raise ValueError(f"more than {MOST_AXES} components")
    turn = rotation(every, axes)
    longest = every.orderBy(F.desc("length"), "id").limit(SEEDS).select("id", "vector").toArrow()  # a fixed number of rows
    seeds = spark.sparkContext.broadcast((longest.column("id").to_numpy(), _matrix(longest.column("vector"), axes)))
    asked = stage(asked.mapInArrow(lambda b: _floors(b, k, axes, seeds), "id long, vector array<long>, floor double, reach double"), "queries")
    asked_count = asked.count()
    groups, blocks = max(1, math.ceil(count / GROUP)), max(1, math.ceil(asked_count / QUERIES))

    # groups by falling length, from quantiles; equal lengths are dealt over the groups that share them
    cuts = every.stat.approxQuantile("length", [g / groups for g in range(1, groups)], 0.5 / groups) if groups > 1 else []
    edges = spark.sparkContext.broadcast(np.sort(-np.array(cuts)))  # eight bytes for each group
    grouped = every.mapInArrow(lambda b: _dealt(b, edges.value), StructType([*every.schema, StructField("grp", IntegerType())]))
    grouped = stage(grouped, "groups")
    most = np.full(groups, -np.inf)
    for r in grouped.groupBy("grp").agg(F.max("length").alias("most")).collect():  # one number for each group
        most[r.grp] = r.most
    reach = spark.sparkContext.broadcast(np.maximum.accumulate(most[::-1])[::-1])
    # a query visits the groups up to the last that is long enough; blocks hold queries of like reach and meet the groups that any of them visits
    cuts = asked.stat.approxQuantile("reach", [g / blocks for g in range(1, blocks)], 0.5 / blocks) if blocks > 1 else []
    parts = spark.sparkContext.broadcast(np.sort(np.array(cuts)))
    held = asked.mapInArrow(lambda b: _visits(b, reach.value, parts.value), StructType([*asked.schema, StructField("visits", IntegerType()), StructField("block", IntegerType())]))
    held = stage(held, "visits")
    sent = held.where("visits > 0").withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("visits") - 1)))
    needed = held.groupBy("block").agg(F.max("visits").alias("visits")).where("visits > 0").select(F.col("block").alias("_block"), F.explode(F.sequence(F.lit(0), F.col("visits") - 1)).alias("_grp"))
    met = grouped.join(needed, F.col("grp") == F.col("_grp")).select("grp", F.col("_block").alias("block"), "id", "vector")
    cells = sent.groupBy("grp", "block").cogroup(met.groupBy("grp", "block")).applyInArrow(lambda a, b: _cell(a, b, k, turn), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    drop_staged(every, asked)
    return cells.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
