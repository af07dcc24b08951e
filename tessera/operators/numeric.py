"""Numeric helpers over tables: products and errors of arrays, quadrature, resizing, noise filters, 3j symbols and coupling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pairs(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Both arrays by index; cells that one of them lacks are zero there."""
    left, right = a.select(*on, F.col("re").alias("ar"), F.col("im").alias("ai")), b.select(*on, F.col("re").alias("br"), F.col("im").alias("bi"))
    return left.join(right, list(on), "full").fillna(0.0, ["ar", "ai", "br", "bi"])


def vdot(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """re, im of the sum of conj(a) * b."""
    both = _pairs(a, b, on)
    return both.agg(F.sum(F.expr("ar * br + ai * bi")).alias("re"), F.sum(F.expr("ar * bi - ai * br")).alias("im"))


def l2error(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """The length of a - b over the larger of both lengths."""
    both = _pairs(a, b, on)
    sums = both.agg(F.sum(F.expr("(ar - br) * (ar - br) + (ai - bi) * (ai - bi)")).alias("d"), F.sum(F.expr("ar * ar + ai * ai")).alias("a"), F.sum(F.expr("br * br + bi * bi")).alias("b"))
    return sums.select(F.coalesce(F.sqrt(F.col("d") / F.nullif(F.greatest("a", "b"), F.lit(0.0))), F.lit(0.0)).alias("l2error"))


def gl_table(spark: SparkSession, n: int) -> DataFrame:
    """i, theta and weight of the Gauss-Legendre nodes, north first; weights add up to 2."""
    x, w = np.polynomial.legendre.leggauss(n)
    return spark.createDataFrame([(i, float(math.acos(v)), float(u)) for i, (v, u) in enumerate(zip(x[::-1], w[::-1], strict=True))], "i long, theta double, weight double")


def gl_weights(spark: SparkSession, nlat: int, nlon: int) -> DataFrame:
    """Weights of the pixels of each ring, so that all pixels' add up to 4 pi."""
    return gl_table(spark, nlat).select("i", (F.col("weight") * F.lit(2 * math.pi / nlon)).alias("weight"))


def integrate(spark: SparkSession, n: int, low: float, high: float, function: str) -> DataFrame:
    """The integral of an SQL expression in ``x`` by ``n`` Gauss-Legendre nodes."""
    nodes = gl_table(spark, n).select((F.cos("theta") * ((high - low) / 2) + (high + low) / 2).alias("x"), "weight")
    return nodes.agg((F.sum(F.col("weight") * F.expr(function)) * ((high - low) / 2)).alias("value"))


def transpose(df: DataFrame, order: dict[str, str]) -> DataFrame:
    """Renames index columns at once: new name to old name."""
    rest = [c for c in df.columns if c not in order.values()]
    return df.select(*[F.col(old).alias(new) for new, old in order.items()], *rest)


def roll_resize_roll(df: DataFrame, shape: dict[str, tuple[int, int, int, int]]) -> DataFrame:
    """Rolls, cuts or zero-pads, and rolls again along axes: index to (length in, length out, roll in, roll out). Zeros have no row."""
    for axis, (n_in, n_out, roll_in, roll_out) in shape.items():
        df = df.withColumn("_i", F.pmod(F.col(axis) + roll_in, F.lit(n_in))).where(F.col("_i") < min(n_in, n_out))
        df = df.withColumn(axis, F.pmod(F.col("_i") + roll_out, F.lit(n_out)).cast("long")).drop("_i")
    return df


def scatter_add(base: DataFrame, updates: DataFrame, on: Sequence[str]) -> DataFrame:
    """Adds the updates' values, of which several may name one cell, to the base."""
    return base.select(*on, "value").unionByName(updates.select(*on, "value")).groupBy(*on).agg(F.sum("value").alias("value"))


def noise_stages(f_min: float, f_knee: float, f_samp: float, slope: float) -> list[tuple[float, float, float]]:
    """Coefficients (x, x before, y before) of first-order stages whose cascade's power goes as f**slope between both frequencies (1/f noise: -1).

    Poles and zeros alternate at even ratios of frequency (Keshner, 1/f noise, Proc. IEEE 70, 1982), as many pairs a decade
    as keep the ripple of the power's logarithm small: a step of half a decade between pairs leaves some 0.1 decades of
    it at the steepest slope, so the number of pairs is rounded up to that.
    Each pair (s + zero) / (s + pole) becomes a digital stage by the bilinear transform s = 2 f_samp (1 - q) / (1 + q).
    """
    n = math.ceil(2 * math.log10(f_knee / f_min)) if f_knee > f_min else 1
    ratio = (f_knee / f_min) ** (1 / n)
    pole = 2 * math.pi * f_min * ratio ** (np.arange(n) + 0.5 + slope / 4)
    zero, rate = pole * ratio ** (-slope / 2), 2 * f_samp
    return list(zip(((rate + zero) / (rate + pole)).tolist(), ((zero - rate) / (rate + pole)).tolist(), ((rate - pole) / (rate + pole)).tolist(), strict=True))


#: Samples that one step of a filter takes at once.
FILTER_BLOCK = 128


def filtered(stages: Sequence[tuple[float, float, float]], values: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A cascade of first-order stages over samples in order, and its state after them (sample and result before, a stage).

    Within a block, results are a triangular matrix of powers times the stage's input, plus what the last result still adds.
    """
    state = np.zeros((len(stages), 2)) if state is None else state.copy()
    x = np.asarray(values, float)
    for k, (a, b, c) in enumerate(stages):
        if not len(x):
            break
        z = a * x + b * np.r_[state[k, 0], x[:-1]]
        state[k, 0] = x[-1]
        powers = c ** np.arange(FILTER_BLOCK + 1)
        lag = np.arange(FILTER_BLOCK)[:, None] - np.arange(FILTER_BLOCK)
        matrix = np.where(lag >= 0, powers[np.maximum(lag, 0)], 0.0)
        y, last = np.empty_like(z), state[k, 1]
        for low in range(0, len(z), FILTER_BLOCK):
            part = z[low : low + FILTER_BLOCK]
            y[low : low + len(part)] = matrix[: len(part), : len(part)] @ part + powers[1 : len(part) + 1] * last
            last = y[low + len(part) - 1]
        state[k, 1] = last
        x = y
    return x, state


def coloured_noise(df: DataFrame, key: str, order: Sequence[str], value: str, sigma: float, f_min: float, f_knee: float, f_samp: float, slope: float) -> DataFrame:
    """Filters each stream's white samples, in order, into noise whose power goes as f**slope; the columns key, order and ``filtered``.

    The state runs along a stream, so a stream is filtered in order; samples arrive sorted, in Arrow batches of bounded
    size, and only the state (two numbers a stage) is carried from one batch to the next. Streams share the tasks.
    ``tessera.streaming.noise`` carries the state between the micro-batches of a stream.
    """
    stages = noise_stages(f_min, f_knee, f_samp, slope)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            keys = batch.column(0)
            values = batch.column(batch.num_columns - 1).fill_null(0.0).to_numpy()
            _, number = np.unique(np.array([str(k) for k in keys.to_pylist()], object).astype(str), return_inverse=True) if batch.num_rows else (None, np.zeros(0, int))
            cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if batch.num_rows else [0]
            out = np.empty(batch.num_rows)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                k = keys[int(a)].as_py()
                if state is None or k != current:
                    current, state = k, None
                out[a:b], state = filtered(stages, values[a:b], state)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out * sigma)], names=[*batch.schema.names[:-1], "filtered"])

    picked = df.select(key, *order, F.col(value).cast("double").alias("_x"))
    placed = picked.repartition(F.col(key)).sortWithinPartitions(key, *order)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]], "filtered double"])
    return placed.mapInArrow(run, schema)


def wigner3j(l2: int, l3: int, m2: int, m3: int) -> tuple[int, np.ndarray]:
    """The least l1 and the symbols (l1 l2 l3; -m2-m3 m2 m3) of all l1, by the published three-term recurrence.

    The recurrence is run from both ends, where it is stable, and both parts are matched at the largest value.
    """
    if abs(m2) > l2 or abs(m3) > l3:
        raise ValueError("|m| must not exceed l")
    m1 = -m2 - m3
    low, high = max(abs(l2 - l3), abs(m1)), l2 + l3
    j = np.arange(low, high + 2, dtype=float)
    a = np.sqrt(np.maximum((j**2 - (l2 - l3) ** 2) * ((l2 + l3 + 1) ** 2 - j**2) * (j**2 - m1**2), 0))
    b = -(2 * j + 1) * (l2 * (l2 + 1.0) * m1 - l3 * (l3 + 1.0) * m1 - j * (j + 1) * (m3 - m2))
    n = high - low + 1
    up, down = np.zeros(n), np.zeros(n)
    up[0] = down[-1] = 1.0
    for k in range(n - 1):
        if low + k == 0:  # the recurrence is void at j = 0: the next value follows from l2, l3 and m2 alone
            up[1] = -(m3 - m2) / (a[1] if a[1] else 1.0) if m2 else 0.0
        else:
            before = up[k - 1] * (j[k] + 1) * a[k] if k else 0.0
            up[k + 1] = -(b[k] * up[k] + before) / (j[k] * a[k + 1])
        top = np.abs(up[: k + 2]).max()
        if top > 1e200:
            up[: k + 2] /= top
    for k in range(n - 1, 0, -1):
        after = down[k + 1] * j[k] * a[k + 1] if k < n - 1 else 0.0
        down[k - 1] = -(b[k] * down[k] + after) / ((j[k] + 1) * a[k])
        top = np.abs(down[k - 1 :]).max()
        if top > 1e200:
            down[k - 1 :] /= top
    mid = int(np.argmax(np.abs(up / np.abs(up).max()) * np.abs(down / np.abs(down).max())))
    out = np.concatenate([up[:mid] * (down[mid] / up[mid]), down[mid:]])
    out /= math.sqrt(float(np.sum((2 * np.arange(low, high + 1) + 1) * out**2)))
    sign = -1.0 if (l2 - l3 - m1) % 2 else 1.0
    return low, out * (sign if out[-1] > 0 else -sign)


def wigner_table(triples: DataFrame) -> DataFrame:
    """l2, l3, m2, m3, l1 and value of all symbols of each row (l2, l3, m2, m3); impossible rows have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([r for r in zip(*(c.to_pylist() for c in batch.columns), strict=True) if None not in r and abs(r[2]) <= r[0] and abs(r[3]) <= r[1]], np.int64).reshape(-1, 4)
            found = [wigner3j(*map(int, r)) for r in rows]
            sizes = [len(v) for _, v in found]
            l1 = [np.arange(low, low + len(v)) for low, v in found]
            columns = [*np.repeat(rows, sizes, axis=0).T, np.concatenate([np.zeros(0, np.int64), *l1]), np.concatenate([np.zeros(0), *[v for _, v in found]])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["l2", "l3", "m2", "m3", "l1", "value"])

    return triples.select(*[F.col(c).cast("long") for c in ("l2", "l3", "m2", "m3")]).mapInArrow(run, "l2 long, l3 long, m2 long, m3 long, l1 long, value double")


def coupling_matrix(spectra: DataFrame, lmax: int, kinds: Sequence[str] = ("00", "02", "++", "--")) -> DataFrame:
    """ispec, kind, l1, l2 (l1 <= l2), value: mode coupling by the mask spectra (ispec, l, value).

    Sums run over the mask's l from l2 - l1 to l1 + l2, with 3j symbols of spins 0 and 2.
    """
    spark = spectra.sparkSession
    pairs = spark.range(lmax + 1).withColumnRenamed("id", "l1").withColumn("l2", F.explode(F.sequence("l1", F.lit(lmax).cast("long"))))
    asked = pairs.select(F.col("l1").alias("l2"), F.col("l2").alias("l3"), F.explode(F.array(F.lit(0), F.lit(-2))).alias("m2")).withColumn("m3", -F.col("m2"))
    symbols = wigner_table(asked).groupBy(F.col("l2").alias("l1"), F.col("l3").alias("l2"), F.col("l1").alias("l"))
    both = symbols.agg(F.sum(F.when(F.col("m2") == 0, F.col("value")).otherwise(0.0)).alias("w0"), F.sum(F.when(F.col("m2") != 0, F.col("value")).otherwise(0.0)).alias("w2"))
    even = (F.col("l1") + F.col("l2") + F.col("l")) % 2 == 0
    square = F.col("w2") * F.col("w2")
    values = {"00": F.col("w0") * F.col("w0"), "02": F.col("w0") * F.col("w2"), "++": F.when(even, square).otherwise(0.0), "--": F.when(even, 0.0).otherwise(square)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), values[k].alias("w")) for k in kinds]))
    met = both.join(spectra.select("ispec", "l", "value"), "l").select("ispec", "l", "l1", "l2", "value", each.alias("e"))
    return met.groupBy("ispec", "e.kind", "l1", "l2").agg(F.sum((2 * F.col("l") + 1) / F.lit(4 * math.pi) * F.col("value") * F.col("e.w")).alias("value"))


def pure_coupling_matrix(spectra: DataFrame, lmax: int) -> DataFrame:
    """ispec, kind, l1, l2, value: mode coupling of pure estimators, by the mask spectra (ispec, kind, l, value) of the kinds 00, 02, 20, 22.

    In place of the spin-2 symbol stands what purification makes of it (Smith 2006): with a = l1 the estimated and b = l2
    the true degree, (b a l; -2 2 0) + 2 sqrt(l (l + 1) / ((a - 1) (a + 2))) (b a l; -2 1 1) + sqrt((l + 2)! / (l - 2)! *
    (a - 2)! / (a + 2)!) (b a l; -2 0 2). Sums run over l with an even l + l1 + l2; below a = 2 only the first term is left.
    """
    spark = spectra.sparkSession
    pairs = spark.range(lmax + 1).withColumnRenamed("id", "a").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lmax).cast("long"))))
    orders = F.explode(F.array(*[F.struct(F.lit(m2).alias("m2"), F.lit(m3).alias("m3")) for m2, m3 in ((0, 0), (-2, 2), (-2, 1), (-2, 0))]))
    asked = pairs.select(F.col("b").alias("l2"), F.col("a").alias("l3"), orders.alias("o")).select("l2", "l3", "o.m2", "o.m3")
    of = lambda m2, m3: F.sum(F.when((F.col("m2") == m2) & (F.col("m3") == m3), F.col("value")).otherwise(0.0))
    found = wigner_table(asked).groupBy(F.col("l3").alias("a"), F.col("l2").alias("b"), F.col("l1").alias("l"))
    held = found.agg(of(0, 0).alias("w0"), of(-2, 2).alias("w2"), of(-2, 1).alias("w1"), of(-2, 0).alias("wz")).where((F.col("a") + F.col("b") + F.col("l")) % 2 == 0)
    a, n = F.col("a").cast("double"), F.col("l").cast("double")
    once = F.when(a > 1, 2 * F.sqrt(n * (n + 1) / ((a - 1) * (a + 2)))).otherwise(0.0)
    twice = F.when(a > 1, F.sqrt(F.greatest((n + 2) * (n + 1) * n * (n - 1), F.lit(0.0)) / ((a + 2) * (a + 1) * a * (a - 1)))).otherwise(0.0)
    held = held.withColumn("pure", F.col("w2") + once * F.col("w1") + twice * F.col("wz"))
    share = F.when(F.col("kind") == "00", F.col("w0") * F.col("w0")).when(F.col("kind") == "22", F.col("pure") * F.col("pure")).otherwise(F.col("w0") * F.col("pure"))
    met = held.join(spectra.where(F.col("kind").isin("00", "02", "20", "22")).select("ispec", "kind", "l", "value"), "l")
    factor = (2 * F.col("l") + 1) * (2 * F.col("b") + 1) / F.lit(4 * math.pi)
    return met.groupBy("ispec", "kind", F.col("a").alias("l1"), F.col("b").alias("l2")).agg(F.sum(factor * F.col("value") * share).alias("value"))


def morton(columns: Sequence[str], bits: int = 20):
    """The bits of two or three integer columns, interleaved from the lowest."""
    n = len(columns)
    out = F.lit(0).cast("long")
    for d, c in enumerate(columns):
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(F.col(c).cast("long"), b).bitwiseAND(F.lit(1).cast("long")), n * b + d))
    return out


def unmorton(column: str, n: int, axis: int, bits: int = 20):
    """One of the ``n`` integers that a Morton number interleaves."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(F.col(column), n * b + axis).bitwiseAND(F.lit(1).cast("long")), b))
    return out
