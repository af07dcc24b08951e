"""Queries of the transforms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spectral as S
from ..sources import tables as T

QUERIES, SQL = {}, {}
PI = repr(math.pi)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rnd(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE"


def _add(name, query, sql):
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    SQL[name] = sql


def _ks(n: int, name: str = "k") -> str:
    return f"(SELECT range AS {name} FROM range({n}))"


def _root(i: str, k: str, n: int, sign: int) -> tuple[str, str]:
    angle = f"({sign} * 2 * {PI}::DOUBLE * (({i} * {k}) % {n}) / {n})"
    return f"cos({angle})", f"sin({angle})"


def dft_sql(source: str, n: int, sign: int = -1, scale: str = "1.0::DOUBLE", keep: int | None = None) -> str:
    c, s = _root("n", "k", n, sign)
    return f"SELECT k AS n, sum(re * {c} - im * {s}) * {scale} AS re, sum(re * {s} + im * {c}) * {scale} AS im FROM ({source}), {_ks(keep or n)} GROUP BY k"


def grid_dft_sql(source: str, nd: int, nh: int, sign: int = -1) -> str:
    """Both axes, by two sums."""
    c, s = _root("h", "kh", nh, sign)
    one = f"SELECT d, kh, sum(re * {c} - im * {s}) AS re, sum(re * {s} + im * {c}) AS im FROM ({source}), {_ks(nh, 'kh')} GROUP BY d, kh"
    c, s = _root("d", "kd", nd, sign)
    return f"SELECT kd AS d, kh AS h, sum(re * {c} - im * {s}) AS re, sum(re * {s} + im * {c}) AS im FROM ({one}), {_ks(nd, 'kd')} GROUP BY kd, kh"


def out(sql: str, index: str, values: str) -> str:
    return f"SELECT {index}, " + ", ".join(f"{rnd(v)} AS {v}" for v in values.split(", ")) + f" FROM ({sql})"


N = T.HOURS
D, H = 12, 10
SIG, REAL, GRID, RGRID = T.hourly_sql(), T.real_hourly_sql(), T.grid_sql(), T.real_grid_sql()
AS_COMPLEX = f"SELECT n, value AS re, 0.0::DOUBLE AS im FROM ({REAL})"
GRID_COMPLEX = f"SELECT d, h, value AS re, 0.0::DOUBLE AS im FROM ({RGRID})"
SHAPE, SHAPE2 = {"n": N}, {"d": D, "h": H}

_add("fft_c2c", lambda s, d: S.c2c(T.hourly(s, d), SHAPE), out(dft_sql(SIG, N), "n", "re, im"))
_add("fft_c2c_backward_ortho", lambda s, d: S.c2c(T.hourly(s, d), SHAPE, forward=False, inorm=1), out(dft_sql(SIG, N, 1, f"(1 / sqrt({N}))"), "n", "re, im"))
_add("fft_c2c_lines", lambda s, d: S.lines(T.hourly(s, d), "n", N), out(dft_sql(SIG, N), "n", "re, im"))
_add("fft_c2c_long_line", lambda s, d: S.long_line(T.hourly(s, d), "n", N), out(dft_sql(SIG, N), "n", "re, im"))
_add("fft_c2c_2d", lambda s, d: S.c2c(T.grid(s, d), SHAPE2), out(grid_dft_sql(GRID, D, H), "d, h", "re, im"))
_add("fft_c2c_real", lambda s, d: S.real_c2c(T.real_hourly(s, d), SHAPE), out(dft_sql(AS_COMPLEX, N), "n", "re, im"))
_add("fft_r2c", lambda s, d: S.r2c(T.real_hourly(s, d), SHAPE, inorm=2), out(dft_sql(AS_COMPLEX, N, -1, f"(1.0::DOUBLE / {N})", N // 2 + 1), "n", "re, im"))
_add("fft_r2c_2d", lambda s, d: S.r2c(T.real_grid(s, d), SHAPE2, ["d", "h"]), out(f"SELECT * FROM ({grid_dft_sql(GRID_COMPLEX, D, H)}) WHERE h <= {H // 2}", "d, h", "re, im"))

HALF = f"SELECT n, re, im FROM ({SIG}) WHERE n <= 60"


def _c2r_sql(source: str, n: int, sign: int) -> str:
    c, s = _root("n", "k", n, sign)
    return f"SELECT k AS n, sum(CASE WHEN n = 0 OR 2 * n = {n} THEN 1 ELSE 2 END * (re * {c} - im * {s})) AS value FROM ({source}), {_ks(n)} GROUP BY k"


_add("fft_c2r_default_odd", lambda s, d: S.c2r(T.hourly(s, d).where("n <= 60"), {"n": 61}), out(_c2r_sql(HALF, 121, 1), "n", "value"))
_add("fft_c2r_even", lambda s, d: S.c2r(T.hourly(s, d).where("n <= 60"), {"n": 61}, lastsize=120), out(_c2r_sql(HALF, 120, 1), "n", "value"))

SMALL = 120
SREAL = T.real_hourly_sql(SMALL)
SCOMPLEX = f"SELECT n, value AS re, 0.0::DOUBLE AS im FROM ({SREAL})"
HALFSPEC = dft_sql(SCOMPLEX, SMALL, -1, "1.0::DOUBLE", SMALL // 2 + 1)
_add("fft_r2r_fftpack", lambda s, d: S.r2r_fftpack(T.real_hourly(s, d, SMALL), {"n": SMALL}), out(f"SELECT greatest(2 * n - 1, 0) AS n, re AS value FROM ({HALFSPEC}) UNION ALL SELECT 2 * n, im FROM ({HALFSPEC}) WHERE n > 0 AND 2 * n < {SMALL}", "n", "value"))
_add("fft_r2r_fftw", lambda s, d: S.r2r_fftw(T.real_hourly(s, d, SMALL), {"n": SMALL}), out(f"SELECT n, re AS value FROM ({HALFSPEC}) UNION ALL SELECT {SMALL} - n, im FROM ({HALFSPEC}) WHERE n > 0 AND 2 * n < {SMALL}", "n", "value"))
UNPACK = f"SELECT (n + 1) // 2 AS n, sum(CASE WHEN n > 0 AND n % 2 = 0 THEN 0 ELSE value END) AS re, sum(CASE WHEN n > 0 AND n % 2 = 0 THEN value ELSE 0 END) AS im FROM ({SREAL}) GROUP BY 1"
_add("fft_r2r_fftpack_back", lambda s, d: S.r2r_fftpack(T.real_hourly(s, d, SMALL), {"n": SMALL}, real2hermitian=False, forward=False), out(_c2r_sql(UNPACK, SMALL, 1), "n", "value"))


def _separable_sql(sign: str) -> str:
    c, s = _root("h", "kh", H, -1)
    one = f"SELECT d, kh, sum(value * ({c} {sign} {s})) AS value FROM ({RGRID}), {_ks(H, 'kh')} GROUP BY d, kh"
    c, s = _root("d", "kd", D, -1)
    return f"SELECT kd AS d, kh AS h, sum(value * ({c} {sign} {s})) AS value FROM ({one}), {_ks(D, 'kd')} GROUP BY kd, kh"


for _name, _function, _sign in (("hartley", S.separable_hartley, "+"), ("fht", S.separable_fht, "-")):
    _add(f"fft_separable_{_name}", lambda s, d, f=_function: f(T.real_grid(s, d), SHAPE2), out(_separable_sql(_sign), "d, h", "value"))
for _name, _function, _sign in (("hartley", S.genuine_hartley, "+"), ("fht", S.genuine_fht, "-")):
    _add(f"fft_genuine_{_name}", lambda s, d, f=_function: f(T.real_grid(s, d), SHAPE2), out(f"SELECT d, h, re {_sign} im AS value FROM ({grid_dft_sql(GRID_COMPLEX, D, H)})", "d, h", "value"))

_M = SMALL
COS = {
    1: f"CASE WHEN n = 0 OR n = {_M - 1} THEN 1 ELSE 2 END * cos({PI}::DOUBLE * ((n * k) % {2 * _M - 2}) / {_M - 1})",
    2: f"2 * cos({PI}::DOUBLE * ((k * (2 * n + 1)) % {4 * _M}) / {2 * _M})",
    3: f"CASE WHEN n = 0 THEN 1 ELSE 2 END * cos({PI}::DOUBLE * ((n * (2 * k + 1)) % {4 * _M}) / {2 * _M})",
    4: f"2 * cos({PI}::DOUBLE * (((2 * n + 1) * (2 * k + 1)) % {8 * _M}) / {4 * _M})",
}
SIN = {
    1: f"2 * sin({PI}::DOUBLE * (((n + 1) * (k + 1)) % {2 * _M + 2}) / {_M + 1})",
    2: f"2 * sin({PI}::DOUBLE * (((k + 1) * (2 * n + 1)) % {4 * _M}) / {2 * _M})",
    3: f"CASE WHEN n = {_M - 1} THEN 1 ELSE 2 END * sin({PI}::DOUBLE * (((n + 1) * (2 * k + 1)) % {4 * _M}) / {2 * _M})",
    4: f"2 * sin({PI}::DOUBLE * (((2 * n + 1) * (2 * k + 1)) % {8 * _M}) / {4 * _M})",
}
for _kind in (1, 2, 3, 4):
    for _name, _function, _kernels in (("dct", S.dct, COS), ("dst", S.dst, SIN)):
        _sql = f"SELECT k AS n, sum(value * {_kernels[_kind]}) AS value FROM ({SREAL}), {_ks(_M)} GROUP BY k"
        _add(f"{_name}{_kind}", lambda s, d, f=_function, kind=_kind: f(T.real_hourly(s, d, SMALL), {"n": SMALL}, kind), out(_sql, "n", "value"))
_ortho = f"SELECT k AS n, sum(value * {COS[2]}) / sqrt({2 * _M}) * CASE WHEN k = 0 THEN sqrt(0.5) ELSE 1 END AS value FROM ({SREAL}), {_ks(_M)} GROUP BY k"
_add("dct2_ortho", lambda s, d: S.dct(T.real_hourly(s, d, SMALL), {"n": SMALL}, 2, inorm=1), out(_ortho, "n", "value"))


def _kernel(spark, sf_dir):
    return spark.range(SMALL).select(F.col("id").alias("n"), F.when(F.col("id").isin(0, 1, SMALL - 1), 1 / (2.0 + F.col("id") % 3)).otherwise(0.0).alias("value"))


_KERNEL_SQL = f"SELECT range AS n, CASE WHEN range IN (0, 1, {SMALL - 1}) THEN 1 / (2.0::DOUBLE + range % 3) ELSE 0 END AS value FROM range({SMALL})"
_CONV = f"SELECT (a.n + b.n) % {SMALL} AS n, sum(a.value * b.value) AS value FROM ({SREAL}) a, ({_KERNEL_SQL}) b GROUP BY 1"
_add("convolve_axis_same", lambda s, d: S.convolve_axis(T.real_hourly(s, d, SMALL), {"n": SMALL}, "n", _kernel(s, d), SMALL), out(_CONV, "n", "value"))


def _resample_sql(n_out: int) -> str:
    spec = dft_sql(f"SELECT n, value AS re, 0.0::DOUBLE AS im FROM ({_CONV})", SMALL, -1, "1.0::DOUBLE", min(SMALL, n_out) // 2 + 1)
    c, s = _root("n", "k", n_out, 1)
    return f"SELECT k AS n, sum(CASE WHEN n = 0 THEN 1 WHEN 2 * n = {min(SMALL, n_out)} THEN {2 if n_out < SMALL else 1} ELSE 2 END * (re * {c} - im * {s})) / {SMALL} AS value FROM ({spec}), {_ks(n_out)} GROUP BY k"


for _n_out in (80, 150):
    _add(f"convolve_axis_to_{_n_out}", lambda s, d, m=_n_out: S.convolve_axis(T.real_hourly(s, d, SMALL), {"n": SMALL}, "n", _kernel(s, d), m), out(_resample_sql(_n_out), "n", "value"))

#: Long axes: with many divisors, a prime, and the one of the waves.
LONG, PRIME, WAVES = 10_080, 10_007, 6_000


def _add_long(name, query, sql, index, values):
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir), 3)
    SQL[name] = f"SELECT {index}, " + ", ".join(f"{rnd(v, 3)} AS {v}" for v in values.split(", ")) + f" FROM ({sql})"


def _prices_complex(n: int) -> str:
    return f"SELECT n, value AS re, 0.0::DOUBLE AS im FROM ({T.prices_sql(n)})"


_add_long("fft_c2c_long_axis", lambda s, d: S.c2c(T.prices(s, d, LONG), {"n": LONG}), dft_sql(_prices_complex(LONG), LONG), "n", "re, im")
_add_long("fft_c2c_prime_axis", lambda s, d: S.c2c(T.prices(s, d, PRIME), {"n": PRIME}, forward=False), dft_sql(_prices_complex(PRIME), PRIME, 1), "n", "re, im")
_add_long("fft_r2c_long_axis", lambda s, d: S.r2c(T.prices(s, d, LONG), {"n": LONG}), dft_sql(_prices_complex(LONG), LONG, -1, "1.0::DOUBLE", LONG // 2 + 1), "n", "re, im")
_add_long("fft_c2r_long_axis", lambda s, d: S.c2r(T.prices(s, d, 5041).select("n", F.col("value").alias("re"), (F.col("value") * F.col("n") / 1000).alias("im")), {"n": 5041}, lastsize=LONG), _c2r_sql(f"SELECT n, value AS re, value * n / 1000 AS im FROM ({T.prices_sql(5041)})", LONG, 1), "n", "value")
_add_long("fft_hartley_long_axis", lambda s, d: S.separable_hartley(T.prices(s, d, LONG), {"n": LONG}), f"SELECT n, re + im AS value FROM ({dft_sql(_prices_complex(LONG), LONG)})", "n", "value")
_add_long("dct2_long_axis", lambda s, d: S.dct(T.prices(s, d, WAVES), {"n": WAVES}, 2), f"SELECT k AS n, sum(value * 2 * cos({PI}::DOUBLE * ((k * (2 * n + 1)) % {4 * WAVES}) / {2 * WAVES})) AS value FROM ({T.prices_sql(WAVES)}), {_ks(WAVES)} GROUP BY k", "n", "value")
_add_long("dst3_long_axis", lambda s, d: S.dst(T.prices(s, d, WAVES), {"n": WAVES}, 3), f"SELECT k AS n, sum(value * CASE WHEN n = {WAVES - 1} THEN 1 ELSE 2 END * sin({PI}::DOUBLE * (((n + 1) * (2 * k + 1)) % {4 * WAVES}) / {2 * WAVES})) AS value FROM ({T.prices_sql(WAVES)}), {_ks(WAVES)} GROUP BY k", "n", "value")
_LONG_KERNEL = f"SELECT range AS n, 1 / (2.0::DOUBLE + range % 3) AS value FROM range({LONG}) WHERE range IN (0, 1, {LONG - 1})"
_add_long("convolve_long_axis", lambda s, d: S.convolve_axis(T.prices(s, d, LONG), {"n": LONG}, "n", s.range(LONG).where(F.col("id").isin(0, 1, LONG - 1)).select(F.col("id").alias("n"), (1 / (2.0 + F.col("id") % 3)).alias("value")), LONG), f"SELECT k AS n, coalesce(value, 0) AS value FROM {_ks(LONG)} LEFT JOIN (SELECT (a.n + b.n) % {LONG} AS n, sum(a.value * b.value) AS value FROM ({T.prices_sql(LONG)}) a, ({_LONG_KERNEL}) b GROUP BY 1) c ON c.n = k", "n", "value")


def _smooth_sql(limit: int, real: bool) -> str:
    powers = " * ".join(f"pow({p}, e{p})" for p in S.PRIMES[: 3 if real else 5])
    tables = ", ".join(f"(SELECT range AS e{p} FROM range({int(math.log(limit, p)) + 1}))" for p in S.PRIMES[: 3 if real else 5])
    return f"SELECT ({powers})::BIGINT AS v FROM {tables} WHERE {powers} <= {limit}"


for _real in (False, True):
    _add("good_size" + "_real" * _real, lambda s, d, real=_real: S.good_sizes(T.table(s, d, "part").select(F.col("p_partkey").alias("n")), "n", 1 << 22, real), f"SELECT p_partkey AS n, v AS good_size FROM part ASOF JOIN ({_smooth_sql(1 << 23, _real)}) ON p_partkey <= v")

_add("power_spectrum_hourly", lambda s, d: S.power_spectrum(S.dense(s, T.real_hourly(s, d), "n", N), N).withColumn("power", F.col("power") / 1e6), f"SELECT n AS k, {rnd('(re * re + im * im) / 1e6')} AS power FROM ({dft_sql(AS_COMPLEX, N, -1, '1.0::DOUBLE', N // 2 + 1)})")
