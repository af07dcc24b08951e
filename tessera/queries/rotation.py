"""Queries of rotated coefficients, derivatives, turned beams and analysis by resampling and least squares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import harmonic as A
from ..operators import interpolated as I
from ..operators import rotation as R
from ..operators import solvers as L
from ..sources import tables as T
from .spectral import out, rounded
from .sphere import _ANGLE, LAMBDA, LEG, LMAX, NPHI, _alm, _alm_sql, _rings
from .sums import _fac, _out

QUERIES, SQL = {}, {}


def _add(name, query, sql, digits: int = 6):
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir), digits)
    SQL[name] = sql


def _full_sql(rows: str) -> str:
    return f"SELECT l, m, re, im FROM ({rows}) UNION ALL SELECT l, -m, CASE WHEN m % 2 = 0 THEN re ELSE -re END, CASE WHEN m % 2 = 0 THEN -im ELSE im END FROM ({rows}) WHERE m > 0"


def _turn_sql(l: str, a: str, b: str, theta: str) -> str:  # noqa: E741
    """The terms of Wigner's sum for d(l, a, b) over s, which the query adds up; 0 where a factorial is of a negative number."""
    parts = [f"{l} + {b} - s", "s", f"{a} - {b} + s", f"{l} - {a} - s"]
    root = " * ".join(_fac(x) for x in (f"{l} + {a}", f"{l} - {a}", f"{l} + {b}", f"{l} - {b}"))
    below = " * ".join(_fac(f"greatest({x}, 0)") for x in parts)
    powers = f"pow(cos({theta} / 2), greatest(2 * {l} + {b} - {a} - 2 * s, 0)) * pow(sin({theta} / 2), greatest({a} - {b} + 2 * s, 0))"
    inside = " AND ".join(f"{x} >= 0" for x in parts)
    return f"CASE WHEN {inside} THEN CASE WHEN ({a} - {b} + s) % 2 = 0 THEN 1 ELSE -1 END * sqrt({root}) / ({below}) * {powers} ELSE 0 END"


PSI, THETA, PHI = 0.4, 2.1, -1.3
STEPS = f"(SELECT range AS s FROM range({2 * LMAX + 1}))"
_tilt = _turn_sql("l", "a.m", "b.m", f"{THETA}::DOUBLE")
_spin = f"(a.m * {PHI}::DOUBLE + b.m * {PSI}::DOUBLE)"
ROTATED = f"SELECT 0::BIGINT AS comp, l, a.m, sum({_tilt} * (re * cos{_spin} + im * sin{_spin})) AS re, sum({_tilt} * (im * cos{_spin} - re * sin{_spin})) AS im FROM ({_full_sql(_alm_sql())}) b JOIN (SELECT range AS m FROM range({LMAX + 1})) a ON a.m <= l, {STEPS} GROUP BY l, a.m"
_add("sht_rotate_alm", lambda s, d: R.rotate_alm(_alm(s, d), PSI, THETA, PHI), out(ROTATED, "comp, l, m", "re, im"))

_slope = "(lam.l * cos(theta) * cur - sqrt((2.0::DOUBLE * lam.l + 1) * (lam.l * lam.l - lam.m * lam.m) / (2 * lam.l - 1)) * prev) / sin(theta)"
_down = f"SELECT lam.ring, a.m, sum(a.re * {_slope}) AS re, sum(a.im * {_slope}) AS im FROM ({_alm_sql()}) a JOIN lam ON a.l = lam.l AND a.m = lam.m GROUP BY lam.ring, a.m"
_across = f"SELECT g.ring, g.m, -g.im * g.m / sin(r.theta) AS re, g.re * g.m / sin(r.theta) AS im FROM ({LEG}) g JOIN (SELECT DISTINCT ring, theta FROM lam) r ON g.ring = r.ring"
_both = f"SELECT 0::BIGINT AS comp, ring, m, re, im FROM ({_down}) UNION ALL SELECT 1::BIGINT, ring, m, re, im FROM ({_across})"
DERIVED = f"SELECT comp, ring, ipix, sum(CASE WHEN m = 0 THEN 1 ELSE 2 END * (re * cos({_ANGLE}) - im * sin({_ANGLE}))) AS value FROM ({_both}), (SELECT range AS ipix FROM range({NPHI})) GROUP BY comp, ring, ipix"
_add("sht_synthesis_deriv1", lambda s, d: A.synthesis_deriv1(_alm(s, d), _rings(s), LMAX, LMAX), f"{LAMBDA} {out(DERIVED, 'comp, ring, ipix', 'value')}")

for _geometry, _n, _s in (("CC", LMAX + 2, 0), ("F1", LMAX + 1, 2), ("MW", LMAX + 1, 2), ("MWflip", LMAX + 1, 0)):
    _comps = 2 if _s else 1
    _add(f"sht_analysis_{_geometry.lower()}_few_rings", lambda s, d, g=_geometry, n=_n, sp=_s, c=_comps: A.analysis_2d(A.synthesis_2d(_alm(s, d, sp, c), g, n, NPHI, LMAX, LMAX, sp), g, n, NPHI, LMAX, LMAX, sp), out(_alm_sql(_s, _comps), "comp, l, m", "re, im"))

KMAX = 2


def _beam(spark, sf_dir):
    return _alm(spark, sf_dir).where(F.col("m") <= KMAX).select("comp", "l", "m", *[(F.col(c) / (1 + F.col("l"))).alias(c) for c in ("re", "im")])


def _pointings(spark, sf_dir):
    return T.directions(spark, sf_dir).select("id", "theta", "phi", F.pmod(F.col("id") * 0.37, F.lit(6.0)).alias("psi"), (F.col("value") / 1000).alias("value"))


BEAM = f"SELECT l, m, re / (1 + l) AS re, im / (1 + l) AS im FROM ({_alm_sql()}) WHERE m <= {KMAX}"
POINTINGS = f"SELECT id, theta, phi, (id * 0.37::DOUBLE) % 6.0::DOUBLE AS psi, value / 1000 AS value FROM ({T.directions_sql()})"
_tilt = _turn_sql("a.l", "a.m", "b.m", "theta")
_spin = "(a.m * phi + b.m * psi)"
SEEN = f"SELECT id, sum({_tilt} * ((a.re * b.re + a.im * b.im) * cos{_spin} - (a.im * b.re - a.re * b.im) * sin{_spin})) AS value FROM ({_full_sql(_alm_sql())}) a JOIN ({_full_sql(BEAM)}) b ON a.l = b.l, ({POINTINGS}), {STEPS} GROUP BY id"
_add("totalconvolve", lambda s, d: R.convolved(_alm(s, d), _beam(s, d), _pointings(s, d), LMAX, KMAX), out(SEEN, "id", "value"))
GIVEN = f"SELECT 0::BIGINT AS comp, a.l, a.m, sum({_tilt} * value * (b.re * cos{_spin} + b.im * sin{_spin})) AS re, sum({_tilt} * value * (b.im * cos{_spin} - b.re * sin{_spin})) AS im FROM (SELECT DISTINCT l, m FROM ({_alm_sql()})) a JOIN ({_full_sql(BEAM)}) b ON a.l = b.l, ({POINTINGS}), {STEPS} GROUP BY a.l, a.m"
_add("totalconvolve_adjoint", lambda s, d: R.convolved_adjoint(_pointings(s, d), _beam(s, d), LMAX, KMAX), _out(GIVEN, "comp, l, m", "re, im", 4), 4)
_add("totalconvolve_interpolated", lambda s, d: I.convolved(_alm(s, d), _beam(s, d), _pointings(s, d), LMAX, KMAX, epsilon=1e-11), _out(SEEN, "id", "value", 4), 4)
_add("totalconvolve_adjoint_interpolated", lambda s, d: I.convolved_adjoint(_pointings(s, d), _beam(s, d), LMAX, KMAX, 1e-11), _out(GIVEN, "comp, l, m", "re, im", 3), 3)
_uneven = lambda s: A.rings_2d(s, "F1", 7, NPHI, 0.03).withColumn("theta", F.col("theta") ** 0.9)
_add("sht_pseudo_analysis", lambda s, d: L.pseudo_analysis(A.synthesis(_alm(s, d), _uneven(s), LMAX, LMAX), _uneven(s), LMAX, LMAX, maxiter=40, epsilon=1e-10).alm, _out(_alm_sql(), "comp, l, m", "re, im", 4), 4)
