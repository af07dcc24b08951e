"""Discrete Fourier, Hartley, cosine and sine transforms of long-form arrays.

An array is a table of index columns (bigint, from 0) with ``re`` and ``im``, or ``value``; cells that are missing are
zero. ``shape`` maps each index column to its length. Along one axis a transform is a weighted sum: every cell is
expanded over the output index and summed by the other axes and it, which Spark combines before the shuffle. Axes
beyond ``EXACT_LENGTH`` go through ``fourier``: ``long_line`` takes two steps of shorter lines as Arrow groups of about
the square root of the length, and lengths without such factors are turned into a convolution of a length that has them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cplx import cis, root, times

Shape = Mapping[str, int]
#: Lengths up to which the weighted sum is used; longer axes are transformed in two steps.
EXACT_LENGTH = 4096
PRIMES = (2, 3, 5, 7, 11)


def norm_factor(inorm: int, n: int) -> float:
    """0: 1, 1: 1 / sqrt(n), 2: 1 / n."""
    if inorm not in (0, 1, 2):
        raise ValueError("inorm must be 0, 1 or 2")
    return (1.0, 1 / math.sqrt(n), 1.0 / n)[inorm]


def checked_axes(shape: Shape, axes: Sequence[str] | None) -> list[str]:
    axes = list(shape) if axes is None else list(axes)
    if not axes or len(set(axes)) != len(axes) or not set(axes) <= set(shape):
        raise ValueError("axes must be different index columns of the array, and at least one")
    return axes


def along(df: DataFrame, axis: str, n_out: int, terms: Callable[[Column, Column], Mapping[str, Column]]) -> DataFrame:
    """Sums of ``terms`` (input index, output index) over ``axis``, by the other index columns and the output index."""
    rest = [c for c in df.columns if c not in (axis, "re", "im", "value")]
    held = [c for c in df.columns if c in ("re", "im", "value")]
    spread = df.select(*rest, F.col(axis).alias("_n"), *held, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_out - 1).cast("long"))).alias(axis))
    return spread.groupBy(*rest, axis).agg(*[F.sum(x).alias(name) for name, x in terms(F.col("_n"), F.col(axis)).items()])


def scaled(df: DataFrame, factor: float) -> DataFrame:
    return df if factor == 1 else df.withColumns({c: F.col(c) * F.lit(factor) for c in df.columns if c in ("re", "im", "value")})


def _sign(forward: bool) -> int:
    return -1 if forward else 1


def lines(df: DataFrame, axis: str, n: int, forward: bool = True) -> DataFrame:
    """The transform along ``axis``, each line in one group; ``n`` bounds the group."""
    rest = [c for c in df.columns if c not in (axis, "re", "im")]

    def one(table: pa.Table) -> pa.Table:
        x = np.zeros(n, complex)
        np.add.at(x, table.column(axis).to_numpy(), table.column("re").to_numpy() + 1j * table.column("im").to_numpy())
        y = np.fft.fft(x) if forward else np.fft.ifft(x) * n
        same = [pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in rest]
        return pa.table([*same, pa.array(np.arange(n)), pa.array(y.real.copy()), pa.array(y.imag.copy())], names=[*rest, axis, "re", "im"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], f"`{axis}` bigint, re double, im double"])
    return df.groupBy(*rest).applyInArrow(one, schema) if rest else df.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(lambda t: one(t.drop_columns(["_all"])), schema)


def long_line(df: DataFrame, axis: str, n: int, forward: bool = True, columns: int | None = None) -> DataFrame:
    """A line of length n = columns * rows by two passes of shorter lines, with a twist in between.

    Index i = columns * i1 + i2 is transformed over i1 for each i2, turned by exp(-+2 pi i k1 i2 / n), and transformed
    over i2 for each k1; the result stands at k1 + rows * k2. No group holds more than max(columns, rows) cells.
    """
    if columns is None:
        columns = _columns(n)
    if n % columns:
        raise ValueError("columns must divide the length")
    rows = n // columns
    split = df.withColumns({"_b": F.pmod(axis, F.lit(columns)).cast("long"), axis: F.floor(F.col(axis) / columns).cast("long")})
    first = lines(split, axis, rows, forward).withColumnRenamed(axis, "_k1")
    re, im = times((F.col("re"), F.col("im")), root(F.col("_k1") * F.col("_b"), n, _sign(forward)))
    turned = first.select(*[c for c in first.columns if c not in ("re", "im")], re.alias("re"), im.alias("im"))
    second = lines(turned, "_b", columns, forward)
    return second.withColumn(axis, F.col("_k1") + F.lit(rows) * F.col("_b")).drop("_k1", "_b")


def _columns(n: int) -> int:
    """The largest divisor of n that is not above its square root."""
    return next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)


def _pair(df: DataFrame, factor: tuple[Column, Column]) -> DataFrame:
    """The table with ``re``, ``im`` multiplied by a complex column."""
    re, im = times((F.col("re"), F.col("im")), factor)
    return df.select(*[c for c in df.columns if c not in ("re", "im")], re.alias("re"), im.alias("im"))


def chirped(df: DataFrame, axis: str, n: int, forward: bool = True) -> DataFrame:
    """A line of any length n, such as a prime, as a convolution with a chirp (Bluestein 1970).

    As 2 i k = i^2 + k^2 - (k - i)^2, the sum is a convolution with exp(+-pi i j^2 / n) between two turns by the same
    chirp. It is done by ``long_line`` at a smooth length of 2 n - 1 or more.
    """
    m, sign = good_size(2 * n - 1), _sign(forward)
    j = F.col("id") - F.lit(n - 1)
    re, im = root(j * j, 2 * n, -sign)
    chirp = df.sparkSession.range(2 * n - 1).select(F.pmod(j, F.lit(m)).alias("_j"), re.alias("re"), im.alias("im"))
    spectrum = long_line(chirp, "_j", m).select("_j", F.col("re").alias("_re"), F.col("im").alias("_im"))
    data = long_line(_pair(df, root(F.col(axis) * F.col(axis), 2 * n, sign)), axis, m)
    product = _pair(data.join(spectrum, F.col(axis) == F.col("_j")), (F.col("_re"), F.col("_im"))).drop("_j", "_re", "_im")
    back = long_line(product, axis, m, False).where(F.col(axis) < n)
    return scaled(_pair(back, root(F.col(axis) * F.col(axis), 2 * n, sign)), 1 / m)


def fourier(df: DataFrame, axis: str, n: int, forward: bool = True) -> DataFrame:
    """The transform of ``re``, ``im`` along a long axis; no group holds more than some square roots of it."""
    if n // _columns(n) <= max(EXACT_LENGTH, 8 * math.isqrt(n)):
        return long_line(df, axis, n, forward)
    return chirped(df, axis, n, forward)


def _as_complex(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("value", "re").withColumn("im", F.lit(0.0))


def c2c(df: DataFrame, shape: Shape, axes: Sequence[str] | None = None, forward: bool = True, inorm: int = 0) -> DataFrame:
    """Complex transform over ``axes``; a table with ``value`` only is real input."""
    axes = checked_axes(shape, axes)
    if "value" in df.columns:
        df = _as_complex(df)
    for axis in axes:
        n = shape[axis]
        if n > EXACT_LENGTH:
            df = fourier(df, axis, n, forward)
            continue

        def terms(i: Column, k: Column, n: int = n) -> dict[str, Column]:
            re, im = times((F.col("re"), F.col("im")), root(i * k, n, _sign(forward)))
            return {"re": re, "im": im}

        df = along(df, axis, n, terms)
    return scaled(df, norm_factor(inorm, math.prod(shape[a] for a in axes)))


def real_c2c(df: DataFrame, shape: Shape, axes: Sequence[str] | None = None, forward: bool = True, inorm: int = 0) -> DataFrame:
    """The full transform of real input: half of the last axis is computed, the other half mirrored."""
    axes = checked_axes(shape, axes)
    last, n = axes[-1], shape[axes[-1]]
    half = r2c(df, shape, axes, forward, inorm)
    other = half.where((F.col(last) > 0) & (F.col(last) < n - n // 2))
    mirrored = other.withColumns({a: F.pmod(F.lit(shape[a]) - F.col(a), F.lit(shape[a])) for a in axes} | {"im": -F.col("im")})
    return half.unionByName(mirrored)


def r2c(df: DataFrame, shape: Shape, axes: Sequence[str] | None = None, forward: bool = True, inorm: int = 0) -> DataFrame:
    """Real input ``value``; the last of ``axes`` goes first and keeps n // 2 + 1 values."""
    axes = checked_axes(shape, axes)
    last, n = axes[-1], shape[axes[-1]]

    def terms(i: Column, k: Column) -> dict[str, Column]:
        c, s = root(i * k, n, _sign(forward))
        return {"re": F.col("value") * c, "im": F.col("value") * s}

    if n > EXACT_LENGTH:
        df = fourier(_as_complex(df), last, n, forward).where(F.col(last) <= n // 2)
    else:
        df = along(df, last, n // 2 + 1, terms)
    if axes[:-1]:
        df = c2c(df, shape, axes[:-1], forward)
    return scaled(df, norm_factor(inorm, math.prod(shape[a] for a in axes)))


def c2r(df: DataFrame, shape: Shape, axes: Sequence[str] | None = None, lastsize: int = 0, forward: bool = False, inorm: int = 0) -> DataFrame:
    """Half-complex to real. ``shape`` is the input's; the last axis comes out ``lastsize`` long, by default 2 n - 1."""
    axes = checked_axes(shape, axes)
    last, half = axes[-1], shape[axes[-1]]
    n = lastsize or 2 * half - 1
    if n // 2 + 1 != half:
        raise ValueError("lastsize does not fit the input's length")
    if axes[:-1]:
        df = c2c(df, shape, axes[:-1], forward)

    def terms(k: Column, i: Column) -> dict[str, Column]:
        c, s = root(i * k, n, _sign(forward))
        once = (k == 0) | (k * 2 == n)
        return {"value": F.when(once, 1.0).otherwise(2.0) * (F.col("re") * c - F.col("im") * s)}

    if n > EXACT_LENGTH:
        other = df.where((F.col(last) > 0) & (F.col(last) * 2 < n)).withColumns({last: F.lit(n) - F.col(last), "im": -F.col("im")})
        df = fourier(df.unionByName(other), last, n, forward).withColumnRenamed("re", "value").drop("im")
    else:
        df = along(df, last, n, terms)
    return scaled(df, norm_factor(inorm, n * math.prod(shape[a] for a in axes[:-1])))


def _pack(df: DataFrame, axis: str, n: int, fftw: bool) -> DataFrame:
    """(k, re, im) to slots: r0 r1 i1 r2 i2 ..., or r0 r1 ... i2 i1."""
    k = F.col(axis)
    re_slot, im_slot = (k, F.lit(n) - k) if fftw else (F.greatest(k * 2 - 1, F.lit(0)), k * 2)
    has_im = (k > 0) & (k * 2 < n)
    rest = [c for c in df.columns if c not in (axis, "re", "im")]
    slots = F.array(F.struct(re_slot.cast("long").alias("s"), F.col("re").alias("v")), F.when(has_im, F.struct(im_slot.cast("long").alias("s"), F.col("im").alias("v"))))
    return df.select(*rest, F.explode(F.array_compact(slots)).alias("_e")).select(*rest, F.col("_e.s").alias(axis), F.col("_e.v").alias("value"))


def _unpack(df: DataFrame, axis: str, n: int, fftw: bool) -> DataFrame:
    s = F.col(axis)
    rest = [c for c in df.columns if c not in (axis, "value")]
    if fftw:
        is_im, k = s > n // 2, F.when(s > n // 2, F.lit(n) - s).otherwise(s)
    else:
        is_im, k = (s > 0) & (s % 2 == 0), F.floor((s + 1) / 2)
    parts = df.select(*rest, k.cast("long").alias(axis), F.when(is_im, 0.0).otherwise(F.col("value")).alias("re"), F.when(is_im, F.col("value")).otherwise(0.0).alias("im"))
    return parts.groupBy(*rest, axis).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def r2r(df: DataFrame, shape: Shape, axes: Sequence[str] | None = None, real2hermitian: bool = True, forward: bool = True, inorm: int = 0, fftw: bool = False) -> DataFrame:
    """Real transforms along each axis in turn, to or from packed half-complex form."""
    axes = checked_axes(shape, axes)
    for axis in axes:
        n = shape[axis]
        if real2hermitian:
            df = _pack(r2c(df, {axis: n}, [axis], forward), axis, n, fftw)
        else:
            df = c2r(_unpack(df, axis, n, fftw), {axis: n // 2 + 1}, [axis], n, forward)
    return scaled(df, norm_factor(inorm, math.prod(shape[a] for a in axes)))


def r2r_fftpack(df: DataFrame, shape: Shape, axes: Sequence[str] | None = None, real2hermitian: bool = True, forward: bool = True, inorm: int = 0) -> DataFrame:
    return r2r(df, shape, axes, real2hermitian, forward, inorm)


def r2r_fftw(df: DataFrame, shape: Shape, axes: Sequence[str] | None = None, real2hermitian: bool = True, forward: bool = True, inorm: int = 0) -> DataFrame:
    return r2r(df, shape, axes, real2hermitian, forward, inorm, fftw=True)


def _separable(df: DataFrame, shape: Shape, axes: Sequence[str] | None, inorm: int, sign: float) -> DataFrame:
    axes = checked_axes(shape, axes)
    for axis in axes:
        n = shape[axis]
        if n > EXACT_LENGTH:
            df = fourier(_as_complex(df), axis, n).withColumn("value", F.col("re") + F.lit(sign) * F.col("im")).drop("re", "im")
            continue

        def terms(i: Column, k: Column, n: int = n) -> dict[str, Column]:
            c, s = root(i * k, n, -1)
            return {"value": F.col("value") * (c + F.lit(sign) * s)}

        df = along(df, axis, n, terms)
    return scaled(df, norm_factor(inorm, math.prod(shape[a] for a in axes)))


def _genuine(df: DataFrame, shape: Shape, axes: Sequence[str] | None, inorm: int, sign: float) -> DataFrame:
    out = c2c(df, shape, axes, True, inorm)
    return out.withColumn("value", F.col("re") + F.lit(sign) * F.col("im")).drop("re", "im")


def separable_hartley(df: DataFrame, shape: Shape, axes: Sequence[str] | None = None, inorm: int = 0) -> DataFrame:
    """Real plus imaginary part of a forward transform, axis by axis."""
    return _separable(df, shape, axes, inorm, 1.0)


def genuine_hartley(df: DataFrame, shape: Shape, axes: Sequence[str] | None = None, inorm: int = 0) -> DataFrame:
    """Real plus imaginary part of the forward transform over all axes."""
    return _genuine(df, shape, axes, inorm, 1.0)


def separable_fht(df: DataFrame, shape: Shape, axes: Sequence[str] | None = None, inorm: int = 0) -> DataFrame:
    """Real minus imaginary part of a forward transform, axis by axis."""
    return _separable(df, shape, axes, inorm, -1.0)


def genuine_fht(df: DataFrame, shape: Shape, axes: Sequence[str] | None = None, inorm: int = 0) -> DataFrame:
    """Real minus imaginary part of the forward transform over all axes."""
    return _genuine(df, shape, axes, inorm, -1.0)


def _weights(kind: int, n: int, sine: bool, ortho: bool) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """What inputs and outputs at the ends of the axis are multiplied by."""
    half = math.sqrt(0.5)
    last = n - 1
    ends = {(1, False): (0, last), (2, False): (0,), (3, False): (0,), (2, True): (last,), (3, True): (last,)}.get((kind, sine), ())
    less_in = (half if ortho else 0.5) if kind in (1, 3) else 1.0
    less_out = half if ortho and kind in (1, 2) else 1.0
    return tuple(lambda i, w=w: F.when(i.isin(*ends), w).otherwise(1.0) if ends and w != 1 else F.lit(1.0) for w in (less_in, less_out))


def _wave(df: DataFrame, axis: str, n: int, kind: int, sine: bool, ortho: bool) -> DataFrame:
    """Sums of 2 value cos(2 pi p q / length), or sin, where p and q are linear in the input's and output's index."""
    if kind not in (1, 2, 3, 4):
        raise ValueError("type must be 1, 2, 3 or 4")
    if kind == 1 and not sine and n < 2:
        raise ValueError("type 1 needs two values or more")
    at_in, at_out = _weights(kind, n, sine, ortho)
    from_one = [int(sine and kind in kinds) for kinds in ((1, 3), (1, 2))]  # sines count from 1 where no half steps are taken
    if n <= EXACT_LENGTH:
        length = {1: 2 * n + 2 if sine else 2 * n - 2, 2: 4 * n, 3: 4 * n, 4: 8 * n}[kind]
        p = lambda i: i * 2 + 1 if kind in (2, 4) else i + from_one[0]
        q = lambda k: k * 2 + 1 if kind in (3, 4) else k + from_one[1]
        wave = F.sin if sine else F.cos
        return along(df, axis, n, lambda i, k: {"value": F.col("value") * 2 * at_in(i) * at_out(k) * wave(F.pmod(p(i) * q(k), F.lit(length)) * F.lit(2 * math.pi / length))})
    i = F.col(axis)
    placed = df.withColumns({"value": F.col("value") * 2 * at_in(i), axis: i + F.lit(from_one[0])})
    line = _as_complex(placed)
    if kind in (3, 4):  # half a step of the output
        line = _pair(line, root(i, 4 * n, -1))
    line = fourier(line, axis, (2 * n + 2 if sine else 2 * n - 2) if kind == 1 else 2 * n)
    if kind == 2:  # half a step of the input
        line = _pair(line, root(i, 4 * n, -1))
    elif kind == 4:
        line = _pair(line, root(i * 2 + 1, 8 * n, -1))
    value = -F.col("im") if sine else F.col("re")
    out = line.withColumn("value", value).drop("re", "im").withColumn(axis, i - F.lit(from_one[1])).where((i >= 0) & (i < n))
    return out.withColumn("value", F.col("value") * at_out(i))


def _trigonometric(df: DataFrame, shape: Shape, axes: Sequence[str] | None, inorm: int, sine: bool, kind: int, delta: int) -> DataFrame:
    axes = checked_axes(shape, axes)
    for axis in axes:
        df = _wave(df, axis, shape[axis], kind, sine, inorm == 1)
    return scaled(df, norm_factor(inorm, math.prod(2 * (shape[a] + (delta if kind == 1 else 0)) for a in axes)))


def dct(df: DataFrame, shape: Shape, kind: int = 2, axes: Sequence[str] | None = None, inorm: int = 0) -> DataFrame:
    """Cosine transform of type 1 to 4; ``inorm`` 1 also makes it orthogonal."""
    return _trigonometric(df, shape, axes, inorm, False, kind, -1)


def dst(df: DataFrame, shape: Shape, kind: int = 2, axes: Sequence[str] | None = None, inorm: int = 0) -> DataFrame:
    """Sine transform of type 1 to 4; ``inorm`` 1 also makes it orthogonal."""
    return _trigonometric(df, shape, axes, inorm, True, kind, 1)


def convolve_axis(df: DataFrame, shape: Shape, axis: str, kernel: DataFrame, n_out: int) -> DataFrame:
    """Circular convolution of real ``value`` along ``axis`` with ``kernel`` (n, value), resampled to ``n_out`` in Fourier space.

    The kernel is as long as the axis and starts at its centre. A shared frequency n / 2 of the shorter length counts
    once when it is cut off from a longer spectrum's two sides, and half on each side when it is added.
    """
    n = shape[axis]
    data = r2c(df, {axis: n}, [axis])
    spectrum = r2c(kernel.select(F.col("n").alias(axis), "value"), {axis: n}, [axis]).select(F.col(axis).alias("_k"), F.col("re").alias("_re"), F.col("im").alias("_im"))
    short = min(n, n_out)
    if n <= EXACT_LENGTH:
        spectrum = F.broadcast(spectrum)  # at most half of EXACT_LENGTH rows
    kept = _pair(data.where(F.col(axis) <= short // 2).join(spectrum, F.col(axis) == F.col("_k")), (F.col("_re"), F.col("_im")))
    if short % 2 == 0 and n_out != n:
        at_nyquist = F.when(F.col(axis) * 2 == short, 2.0 if n_out < n else 0.5).otherwise(1.0)
        kept = kept.withColumns({c: F.col(c) * at_nyquist for c in ("re", "im")})
    return scaled(c2r(kept.drop("_k", "_re", "_im"), {axis: n_out // 2 + 1}, [axis], n_out), 1 / n)


def smooth_numbers(limit: int, real: bool = False) -> list[int]:
    """All products of 2, 3, 5 (and 7, 11 unless ``real``) up to ``limit``, in order."""
    out = [1]
    for p in PRIMES[: 3 if real else 5]:
        for v in out:
            if v * p <= limit:
                out.append(v * p)
    return sorted(out)


def good_size(n: int, real: bool = False) -> int:
    """The least efficient transform length that is not below ``n``."""
    return next(v for v in smooth_numbers(2 * max(1, n), real) if v >= n)


def good_sizes(df: DataFrame, column: str, limit: int, real: bool = False) -> DataFrame:
    """Adds ``good_size`` to a table of lengths up to ``limit``; the smooth numbers up to twice that are a short literal.

    They are halved again and again to find the first that is not below a length; lengths above all of them get null.
    """
    known, n = smooth_numbers(2 * limit, real), F.col(column)
    numbers = F.split(F.lit(",".join(map(str, known))), ",").cast("array<long>")
    halves = F.array(*[F.lit(1 << b) for b in range(len(known).bit_length() - 1, -1, -1)])
    below = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get(numbers, at + step - 1) < n, at + step).otherwise(at))
    return df.withColumn("good_size", F.when(n.isNotNull(), F.get(numbers, below)))


def power_spectrum(df: DataFrame, n: int, axis: str = "n") -> DataFrame:
    """|X_k|^2 of a real signal for k up to n / 2."""
    return r2c(df, {axis: n}, [axis]).select(F.col(axis).alias("k"), (F.col("re") ** 2 + F.col("im") ** 2).alias("power"))


def dense(spark: SparkSession, df: DataFrame, axis: str, n: int, column: str = "value") -> DataFrame:
    """All cells of a line, 0 where the table has none."""
    return spark.range(n).select(F.col("id").alias(axis)).join(df, axis, "left").withColumn(column, F.coalesce(column, F.lit(0.0)))


__all__ = ["c2c", "c2r", "chirped", "cis", "convolve_axis", "dct", "dst", "fourier", "genuine_fht", "genuine_hartley", "good_size", "good_sizes", "lines", "long_line", "power_spectrum", "r2c", "r2r", "r2r_fftpack", "r2r_fftw", "real_c2c", "separable_fht", "separable_hartley"]
