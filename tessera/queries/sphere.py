"""Queries of sphere pixels, range sets and harmonic transforms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import curves as V
from ..operators import harmonic as A
from ..operators import interpolated as I
from ..operators import ranges as R
from ..operators import sphere as P
from ..sources import tables as T
from .spectral import out, rnd, rounded

QUERIES, SQL = {}, {}
NSIDE = 8
PI = repr(math.pi)


def _add(name, query, sql, digits: int = 6):
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir), digits)
    if sql:
        SQL[name] = sql


def rounded_out(sql: str, index: str, values: str, digits: int) -> str:
    return f"SELECT {index}, " + ", ".join(f"{rnd(v, digits)} AS {v}" for v in values.split(", ")) + f" FROM ({sql})"


def centers_sql(n: int = NSIDE) -> str:
    """pix, ring, nphi, ringstart, z, theta and phi of all RING pixels."""
    cap, npix = 2 * n * (n - 1), 12 * n * n
    ring = f"CASE WHEN p < {cap} THEN floor((1 + sqrt(1 + 2 * p)) / 2) WHEN p < {npix - cap} THEN (p - {cap}) // {4 * n} + {n} ELSE {4 * n} - floor((1 + sqrt(2 * ({npix} - p) - 1)) / 2) END"
    one = f"SELECT range AS p, ({ring.replace('p ', 'range ').replace(' p)', ' range)').replace('(p -', '(range -').replace('- p)', '- range)')})::BIGINT AS ring FROM range({npix})"
    two = f"SELECT p, ring, least(ring, {n}, {4 * n} - ring) AS q, CASE WHEN ring < {n} OR ring > {3 * n} OR (ring - {n}) % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS s, CASE WHEN ring < {n} THEN 2 * ring * (ring - 1) WHEN ring <= {3 * n} THEN {cap} + {4 * n} * (ring - {n}) ELSE {npix} - 2 * ({4 * n} - ring) * ({4 * n} - ring + 1) END AS start, CASE WHEN ring < {n} THEN 1 - ring * ring / {3.0 * n * n}::DOUBLE WHEN ring <= {3 * n} THEN 2 * ({2 * n} - ring) / {3.0 * n}::DOUBLE ELSE ({4 * n} - ring) * ({4 * n} - ring) / {3.0 * n * n}::DOUBLE - 1 END AS z FROM ({one})"
    return f"SELECT p AS pix, ring, 4 * q AS nphi, start AS ringstart, z, acos(z) AS theta, (p - start + s) * {PI}::DOUBLE / (2 * q) AS phi, s * {PI}::DOUBLE / (2 * q) AS phi0 FROM ({two})"


def locate_sql(points: str, n: int = NSIDE) -> str:
    """Adds the RING pixel of (theta, phi)."""
    a = f"SELECT *, cos(theta) AS _z, phi / ({PI}::DOUBLE / 2) - 4 * floor(phi / ({PI}::DOUBLE / 2) / 4) AS _t FROM ({points})"
    b = f"SELECT *, floor({n} * (0.5 + _t) - 0.75 * {n} * _z)::BIGINT AS _jp, floor({n} * (0.5 + _t) + 0.75 * {n} * _z)::BIGINT AS _jm, {n} * sqrt(3 * (1 - abs(_z))) AS _f, _t - floor(_t) AS _u FROM ({a})"
    c = f"SELECT *, {n} + 1 + _jp - _jm AS _r, least(floor(_u * _f)::BIGINT, {n - 1}) + least(floor((1 - _u) * _f)::BIGINT, {n - 1}) + 1 AS _c FROM ({b})"
    belt = f"{2 * n * (n - 1)} + (_r - 1) * {4 * n} + ((_jp + _jm - {n} + 1 + CASE WHEN _r % 2 = 0 THEN 1 ELSE 0 END) // 2) % {4 * n}"
    i = "floor(_t * _c)::BIGINT % (4 * _c)"
    return f"SELECT *, CASE WHEN abs(_z) <= 2.0 / 3 THEN {belt} WHEN _z > 0 THEN 2 * _c * (_c - 1) + {i} ELSE {12 * n * n} - 2 * _c * (_c + 1) + {i} END AS pix FROM ({c})"


NPIX = 12 * NSIDE * NSIDE


def _pixels(spark, sf_dir):
    """Pixel numbers from the keys of all order lines, with the mean quantity as value."""
    pix = F.pmod(F.col("l_orderkey") * 4 + F.col("l_linenumber"), F.lit(NPIX)).cast("long")
    return T.table(spark, sf_dir, "lineitem").groupBy(pix.alias("pix")).agg(F.avg("l_quantity").cast("double").alias("value"))


PIXELS = f"SELECT ((l_orderkey * 4 + l_linenumber) % {NPIX})::BIGINT AS pix, avg(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1"
PTG, CENTERS = T.directions_sql(), centers_sql()
VEC = "sin(theta) * cos(phi) AS x, sin(theta) * sin(phi) AS y, cos(theta) AS z"
HELD = f"SELECT c.* FROM ({CENTERS}) c JOIN ({PIXELS}) p ON c.pix = p.pix"
_add("healpix_pix2ang", lambda s, d: P.pix2ang(_pixels(s, d).select("pix"), NSIDE), out(HELD, "pix", "theta, phi"))
_add("healpix_pix2vec", lambda s, d: P.pix2vec(_pixels(s, d).select("pix"), NSIDE), out(f"SELECT pix, {VEC} FROM (SELECT pix, theta, phi FROM ({HELD}))", "pix", "x, y, z"))
_add("healpix_ang2pix", lambda s, d: P.ang2pix(T.directions(s, d), NSIDE).select("id", "pix"), f"SELECT id, pix FROM ({locate_sql(PTG)})")
_add("healpix_map", lambda s, d: P.ang2pix(T.directions(s, d), NSIDE).groupBy("pix").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")), f"SELECT pix, round(avg(value), 6) + 0.0::DOUBLE AS value, count(*) AS n FROM ({locate_sql(PTG)}) GROUP BY pix")
_add("healpix_round_trip", lambda s, d: P.vec2pix(P.pix2vec(P.nest2ring(P.ring2nest(_pixels(s, d).select("pix"), NSIDE).select("nest"), NSIDE), NSIDE), NSIDE, "RING", "back").select("pix", "back"), f"SELECT pix, pix AS back FROM ({PIXELS})")
_bits = lambda k: " + ".join(f"((pix >> {2 * b + k}) & 1) * {1 << b}" for b in range(3))
_add("healpix_nest_xyf", lambda s, d: P.pix2xyf(_pixels(s, d).select("pix"), NSIDE, "NEST"), f"SELECT pix, {_bits(0)} AS ix, {_bits(1)} AS iy, pix // 64 AS face FROM ({PIXELS})")
_add("healpix_peano", lambda s, d: _pixels(s, d).select("pix").withColumn("peano", V.nest2peano("pix", NSIDE)).withColumn("back", V.peano2nest("peano", NSIDE)), f"SELECT a AS pix, a // 64 * 64 + d AS peano, a AS back FROM (" + T.curve_sql(f"SELECT pix AS a, 0 AS b, {_bits(0)} AS x, {_bits(1)} AS y FROM ({PIXELS})", 3) + ")")
# a point of a face at (x, y) from 0 to 1, and the corners of NEST pixels, by the published map from faces to the sphere
_down = "(face // 4 + 2 - x - y)"
_near = f"CASE WHEN {_down} < 1 THEN {_down} WHEN {_down} > 3 THEN 4 - {_down} ELSE 1.0::DOUBLE END"


def _place(rows: str) -> str:
    z = f"CASE WHEN {_down} < 1 THEN 1 - near * near / 3 WHEN {_down} > 3 THEN near * near / 3 - 1 ELSE (x + y - face // 4) * 2 / 3 END"
    side = "(turn * near + x - y)"
    phi = f"CASE WHEN near < 1e-12 THEN 0 ELSE {PI}::DOUBLE / 4 * ({side} - 8 * floor({side} / 8)) / near END"
    return f"SELECT pix, point, {z} AS z, {phi} AS phi FROM (SELECT *, {_near} AS near, CASE WHEN face // 4 = 1 THEN 2 * (face % 4) ELSE 2 * (face % 4) + 1 END AS turn FROM ({rows}))"


_faces = f"SELECT range AS pix, range // 64 AS face, {_bits(0).replace('pix', 'range')} AS ix, {_bits(1).replace('pix', 'range')} AS iy FROM range({NPIX})"
_corner = "SELECT * FROM (VALUES (0, 1.0::DOUBLE, 1.0::DOUBLE), (1, 0.5, 1.0), (2, 0.0, 1.0), (3, 0.0, 0.5), (4, 0.0, 0.0), (5, 0.5, 0.0), (6, 1.0, 0.0), (7, 1.0, 0.5)) k(point, a, b)"
BORDERS = _place(f"SELECT pix, face, point, (ix + a) / {NSIDE}.0::DOUBLE AS x, (iy + b) / {NSIDE}.0::DOUBLE AS y FROM ({_faces}), ({_corner})")
_add("healpix_boundaries", lambda s, d: P.boundaries(_pixels(s, d).select("pix"), NSIDE, 2, "NEST").select("pix", "point", "z", F.sin("phi").alias("sine"), F.cos("phi").alias("cosine")), out(f"SELECT b.pix, point, z, sin(phi) AS sine, cos(phi) AS cosine FROM ({BORDERS}) b JOIN ({PIXELS}) p ON b.pix = p.pix", "pix, point", "z, sine, cosine"))
_spots = f"SELECT pix, round(sqrt(greatest(0, 1 - z * z)) * cos(phi), 5) + 0.0::DOUBLE AS x, round(sqrt(greatest(0, 1 - z * z)) * sin(phi), 5) + 0.0::DOUBLE AS y, round(z, 5) + 0.0::DOUBLE AS z FROM ({BORDERS}) WHERE point % 2 = 0"
_add("healpix_neighbors", lambda s, d: P.neighbors(_pixels(s, d).select("pix"), NSIDE, "NEST").select("pix", "neighbor").distinct(), f"WITH spots AS ({_spots}) SELECT DISTINCT a.pix, b.pix AS neighbor FROM spots a JOIN spots b ON abs(a.x - b.x) < 2e-5 AND abs(a.y - b.y) < 2e-5 AND abs(a.z - b.z) < 2e-5 AND a.pix <> b.pix JOIN ({PIXELS}) p ON a.pix = p.pix")
_ring_table = f"SELECT ring, any_value(theta) AS theta, count(*) AS nphi, min(phi) AS phi0, min(pix) AS ringstart FROM ({CENTERS}) GROUP BY ring"
_add("healpix_rings", lambda s, d: P.rings(s, NSIDE).join(P.pix2ring(_pixels(s, d), NSIDE).groupBy("ring").agg(F.count(F.lit(1)).alias("held")), "ring"), f"SELECT r.ring, round(theta, 6) + 0.0::DOUBLE AS theta, nphi, round(phi0, 6) + 0.0::DOUBLE AS phi0, ringstart, held FROM ({_ring_table}) r JOIN (SELECT ring, count(*) AS held FROM ({HELD}) GROUP BY ring) h ON r.ring = h.ring")
# linear along the rings above and below a direction and between them; beyond the outermost rings the pole takes part, here left out
_between = f"SELECT p.*, r.*, lead_theta FROM (SELECT id, theta AS t, phi AS f FROM ({PTG})) p JOIN (SELECT *, lead(theta) OVER (ORDER BY ring) AS lead_theta, lag(theta) OVER (ORDER BY ring) AS lag_theta FROM ({_ring_table})) r ON (p.t >= r.theta AND p.t < lead_theta) OR (p.t < r.theta AND p.t >= lag_theta)"
_along = f"SELECT id, ringstart, nphi, CASE WHEN t >= theta THEN 1 - (t - theta) / (lead_theta - theta) ELSE 1 - (theta - t) / (theta - lag_theta) END AS share, (f - phi0) / (2 * {PI}::DOUBLE / nphi) AS spot FROM ({_between.replace('lead_theta FROM', 'lead_theta, lag_theta FROM', 1)})"
_pairs = f"SELECT id, ringstart + ((floor(spot)::BIGINT + k) %% nphi + nphi) %% nphi AS pix, share * CASE WHEN k = 0 THEN 1 - (spot - floor(spot)) ELSE spot - floor(spot) END AS weight FROM ({_along}), (SELECT unnest([0, 1]) AS k)".replace("%%", "%")
_inner = f"(SELECT min(theta) FROM ({_ring_table}))"
_add("healpix_interpolate", lambda s, d: P.interpolation(T.directions(s, d).select("id", "theta", "phi").where("theta > 0.11 and theta < 3.03"), NSIDE).select("id", "pix", "weight"), out(f"SELECT w.id, pix, weight FROM ({_pairs}) w JOIN ({PTG}) p ON p.id = w.id WHERE theta > 0.11 AND theta < 3.03", "id, pix", "weight"))


def _discs(spark, sf_dir):
    n = T.table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.acos(1 - (2 * F.col("n_nationkey") + 1.0) / 25).alias("theta"), (F.col("n_nationkey") * 0.7).alias("phi"), (0.05 + F.col("n_nationkey") * 0.04).alias("radius"))


DISCS = "SELECT n_nationkey::BIGINT AS id, acos(1 - (2 * n_nationkey + 1.0::DOUBLE) / 25) AS theta, n_nationkey * 0.7::DOUBLE AS phi, 0.05::DOUBLE + n_nationkey * 0.04::DOUBLE AS radius FROM nation"
INSIDE = f"SELECT d.id, c.pix FROM ({DISCS}) d JOIN ({CENTERS}) c ON cos(d.theta) * c.z + sin(d.theta) * sin(c.theta) * cos(c.phi - d.phi) >= cos(d.radius)"
_add("healpix_query_disc", lambda s, d: R.values(P.query_disc(_discs(s, d), NSIDE), ["id"]).withColumnRenamed("value", "pix"), INSIDE)
_add("healpix_query_disc_nest", lambda s, d: P.query_disc(_discs(s, d), NSIDE, "NEST").groupBy("id").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")), f"SELECT id, count(*) AS n FROM ({INSIDE}) GROUP BY id")
_add("healpix_query_strip", lambda s, d: _pixels(s, d).join(R.values(P.query_strip(s, NSIDE, 0.4, 1.1)).withColumnRenamed("value", "pix"), "pix", "left_semi").select("pix"), f"SELECT pix FROM ({HELD}) WHERE theta BETWEEN 0.4 AND 1.1")
CORNERS = [(0.4, 0.1), (1.3, 0.2), (1.2, 1.4)]
_sides = np.cross(*[np.array([P.H.ang2vec(t, p) for t, p in c]) for c in (CORNERS, CORNERS[1:] + CORNERS[:1])])
_sides *= np.sign(_sides[0] @ np.array(P.H.ang2vec(*CORNERS[2])))
_plane = " AND ".join(f"sin(theta) * cos(phi) * {a!r}::DOUBLE + sin(theta) * sin(phi) * {b!r}::DOUBLE + cos(theta) * {c!r}::DOUBLE >= 0" for a, b, c in _sides.tolist())
_add("healpix_query_polygon", lambda s, d: _pixels(s, d).join(R.values(P.query_polygon(s, NSIDE, CORNERS)).withColumnRenamed("value", "pix"), "pix", "left_semi").select("pix"), f"SELECT pix FROM ({HELD}) WHERE {_plane}")
_add("healpix_degrade", lambda s, d: P.degrade(_pixels(s, d), NSIDE, 4, "NEST"), f"SELECT pix // 4 AS pix, round(avg(value), 6) + 0.0::DOUBLE AS value, count(*) AS n FROM ({PIXELS}) GROUP BY 1")
_add("healpix_upgrade", lambda s, d: P.upgrade(_pixels(s, d), NSIDE, 16, "NEST"), f"SELECT pix * 4 + k AS pix, round(value, 6) + 0.0::DOUBLE AS value FROM ({PIXELS}), (SELECT range AS k FROM range(4))")

KEYS = ["key"]


def _set(spark, sf_dir, flag):
    x = F.col("l_partkey")
    return T.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_linenumber").cast("long").alias("key"), x.alias("lo"), (x + F.col("l_quantity").cast("long") % 3).alias("hi"))


def _set_sql(flag):
    return f"SELECT DISTINCT l_linenumber::BIGINT AS key, unnest(range(l_partkey, l_partkey + l_quantity::BIGINT % 3)) AS v FROM lineitem WHERE l_returnflag = '{flag}'"


def _islands(values):
    return f"SELECT key, min(v) AS lo, max(v) + 1 AS hi FROM (SELECT key, v, v - row_number() OVER (PARTITION BY key ORDER BY v) AS g FROM ({values})) GROUP BY key, g"


_a, _b = _set_sql("A"), _set_sql("R")
_add("rangeset_normalise", lambda s, d: R.normalise(_set(s, d, "A"), KEYS), _islands(_a))
for _name, _values in {"or": f"{_a} UNION {_b}", "and": f"{_a} INTERSECT {_b}", "andnot": f"{_a} EXCEPT {_b}", "xor": f"(({_a}) UNION ({_b})) EXCEPT (({_a}) INTERSECT ({_b}))"}.items():
    _add(f"rangeset_{_name}", lambda s, d, o=_name: R.combine(_set(s, d, "A"), _set(s, d, "R"), o, KEYS), _islands(_values))
_add("rangeset_sizes", lambda s, d: R.sizes(_set(s, d, "A"), KEYS), f"SELECT key, count(*) AS n_ranges, sum(hi - lo)::BIGINT AS n_values FROM ({_islands(_a)}) GROUP BY key")
_add("rangeset_uniq_round_trip", lambda s, d: R.from_uniq(R.to_uniq(_set(s, d, "A"), 6, KEYS), 6, KEYS), _islands(_a))

LMAX = 4


def _alm(spark, sf_dir, least: int = 0, comps: int = 1):
    """Coefficients from the order lines: means of prices and quantities by order number; m = 0 is real."""
    side = LMAX + 1
    k = F.pmod("l_orderkey", F.lit(comps * side * side)).cast("long")
    held = T.table(spark, sf_dir, "lineitem").groupBy(k.alias("k")).agg((F.avg("l_extendedprice") / 10000 - 3).alias("re"), (F.avg("l_quantity") / 10 - 2).alias("im"))
    t = held.select(F.floor(F.col("k") / (side * side)).cast("long").alias("comp"), F.pmod(F.floor(F.col("k") / side), F.lit(side)).cast("long").alias("l"), F.pmod("k", F.lit(side)).cast("long").alias("m"), F.col("re").cast("double"), F.col("im").cast("double"))
    return t.where((F.col("m") <= F.col("l")) & (F.col("l") >= least)).withColumn("im", F.when(F.col("m") == 0, 0.0).otherwise(F.col("im")))


def _alm_sql(least: int = 0, comps: int = 1):
    side = LMAX + 1
    held = f"SELECT (l_orderkey % {comps * side * side})::BIGINT AS k, (avg(l_extendedprice) / 10000 - 3)::DOUBLE AS re, (avg(l_quantity) / 10 - 2)::DOUBLE AS im FROM lineitem GROUP BY 1"
    return f"SELECT comp, l, m, re, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE im END AS im FROM (SELECT k // {side * side} AS comp, (k // {side}) % {side} AS l, k % {side} AS m, re, im FROM ({held})) WHERE m <= l AND l >= {least}"


_factor = lambda m: math.sqrt((2 * m + 1) / (4 * math.pi) * math.factorial(2 * m)) / (2**m * math.factorial(m)) * (-1) ** m
_eps = lambda l: f"sqrt(({l} * {l} - m * m) / (4.0::DOUBLE * {l} * {l} - 1))"  # noqa: E731, E741
_THETAS = A.ring_thetas("F1", 6)
RINGS = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {t!r}::DOUBLE)" for i, t in enumerate(_THETAS.tolist())) + ") r(ring, theta)"
SEEDS = "SELECT * FROM (VALUES " + ", ".join(f"({m}::BIGINT, {_factor(m)!r}::DOUBLE)" for m in range(LMAX + 1)) + ") f(m, f)"
LAMBDA = f"WITH RECURSIVE lam(ring, theta, m, l, cur, prev) AS (SELECT ring, theta, m, m, f * pow(sin(theta), m), 0.0::DOUBLE FROM ({RINGS}), ({SEEDS}) UNION ALL SELECT ring, theta, m, l + 1, (cos(theta) * cur - CASE WHEN l > m THEN {_eps('l')} ELSE 0 END * prev) / {_eps('(l + 1)')}, cur FROM lam WHERE l < {LMAX})"
LEG = f"SELECT 0::BIGINT AS comp, lam.ring, a.m, sum(a.re * cur) AS re, sum(a.im * cur) AS im FROM ({_alm_sql()}) a JOIN lam ON a.l = lam.l AND a.m = lam.m GROUP BY lam.ring, a.m"
NPHI = 10
_ANGLE = f"(m * (0.03::DOUBLE + ipix * 2 * {PI}::DOUBLE / {NPHI}))"
MAP = f"SELECT comp, ring, ipix, sum(CASE WHEN m = 0 THEN 1 ELSE 2 END * (re * cos({_ANGLE}) - im * sin({_ANGLE}))) AS value FROM ({LEG}), (SELECT range AS ipix FROM range({NPHI})) GROUP BY comp, ring, ipix"
_rings = lambda s: A.rings_2d(s, "F1", 6, NPHI, 0.03)
_map = lambda s, d: A.synthesis(_alm(s, d), _rings(s), LMAX, LMAX)
_add("sht_alm2leg", lambda s, d: A.alm2leg(_alm(s, d), _rings(s), LMAX, LMAX), f"{LAMBDA} {out(LEG, 'comp, ring, m', 're, im')}")
_add("sht_synthesis", lambda s, d: _map(s, d), f"{LAMBDA} {out(MAP, 'comp, ring, ipix', 'value')}")
BACK = f"SELECT comp, ring, m, sum(value * cos({_ANGLE})) AS re, -sum(value * sin({_ANGLE})) AS im FROM ({MAP}), (SELECT range AS m FROM range({LMAX + 1})) GROUP BY comp, ring, m"
_add("sht_map2leg", lambda s, d: A.map2leg(_map(s, d), _rings(s), LMAX), f"{LAMBDA} {out(BACK, 'comp, ring, m', 're, im')}")
ADJOINT = f"SELECT comp, lam.l, lam.m, sum(b.re * cur) AS re, sum(b.im * cur) AS im FROM ({BACK}) b JOIN lam ON b.ring = lam.ring AND b.m = lam.m GROUP BY comp, lam.l, lam.m"
_add("sht_adjoint_synthesis", lambda s, d: A.adjoint_synthesis(_map(s, d), _rings(s), LMAX, LMAX), f"{LAMBDA} {out(ADJOINT, 'comp, l, m', 're, im')}")
for _geometry, _n in {"GL": LMAX + 1, "CC": 2 * LMAX + 2, "F1": 2 * LMAX + 1, "F2": 2 * LMAX + 1, "DH": 2 * LMAX + 2}.items():
    for _spin, _comps in ((0, 1), (2, 2)):
        _add(f"sht_analysis_{_geometry.lower()}_spin{_spin}", lambda s, d, g=_geometry, n=_n, sp=_spin, c=_comps: A.analysis_2d(A.synthesis_2d(_alm(s, d, sp, c), g, n, NPHI, LMAX, LMAX, sp), g, n, NPHI, LMAX, LMAX, sp), out(_alm_sql(_spin, _comps), "comp, l, m", "re, im"))
_points = lambda s, d: T.directions(s, d).withColumn("value", F.col("value") / 1000)
POINTS = f"SELECT id AS ring, theta, phi, value / 1000 AS value FROM ({PTG})"
AT_POINTS = LAMBDA.replace(RINGS, f"SELECT ring, theta FROM ({POINTS})")
GENERAL = f"SELECT 0::BIGINT AS comp, lam.ring AS id, sum(CASE WHEN a.m = 0 THEN 1 ELSE 2 END * cur * (a.re * cos(a.m * phi) - a.im * sin(a.m * phi))) AS value FROM ({_alm_sql()}) a JOIN lam ON a.l = lam.l AND a.m = lam.m JOIN ({POINTS}) p ON p.ring = lam.ring GROUP BY lam.ring"
GENERAL_ADJOINT = f"SELECT 0::BIGINT AS comp, lam.l, lam.m, sum(value * cur * cos(lam.m * phi)) AS re, -sum(value * cur * sin(lam.m * phi)) AS im FROM lam JOIN ({POINTS}) p ON p.ring = lam.ring GROUP BY lam.l, lam.m"
_add("sht_general", lambda s, d: A.synthesis_general(_alm(s, d), _points(s, d), LMAX, LMAX), f"{AT_POINTS} {out(GENERAL, 'comp, id', 'value')}")
_add("sht_general_adjoint", lambda s, d: A.adjoint_synthesis_general(_points(s, d), LMAX, LMAX), f"{AT_POINTS} {rounded_out(GENERAL_ADJOINT, 'comp, l, m', 're, im', 4)}", 4)
_add("sht_general_interpolated", lambda s, d: I.synthesis_general(_alm(s, d), _points(s, d), LMAX, LMAX, epsilon=1e-11), f"{AT_POINTS} {rounded_out(GENERAL, 'comp, id', 'value', 5)}", 5)
_add("sht_general_adjoint_interpolated", lambda s, d: I.adjoint_synthesis_general(_points(s, d), LMAX, LMAX, epsilon=1e-11), f"{AT_POINTS} {rounded_out(GENERAL_ADJOINT, 'comp, l, m', 're, im', 3)}", 3)
_add("sht_full_alm", lambda s, d: A.to_full(_alm(s, d)), out(f"SELECT comp, l, m, re, im FROM ({_alm_sql()}) UNION ALL SELECT comp, l, -m, CASE WHEN m % 2 = 0 THEN re ELSE -re END, CASE WHEN m % 2 = 0 THEN -im ELSE im END FROM ({_alm_sql()}) WHERE m > 0", "comp, l, m", "re, im"))
