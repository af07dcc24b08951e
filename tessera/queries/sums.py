"""Queries of nonuniform sums, gridding, pointing and numeric helpers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import circles as C
from ..operators import curves as V
from ..operators import gridding as G
from ..operators import nonuniform as N
from ..operators import numeric as M
from ..operators import pointing as Q
from ..operators import sphere as S
from ..sources import tables as T
from .spectral import rnd, rounded

QUERIES, SQL = {}, {}
PI = repr(math.pi)
TAU = f"(2 * {PI}::DOUBLE)"


def _add(name, query, sql, digits: int = 6):
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir), digits)
    if sql:
        SQL[name] = sql


def _out(sql, index, values, digits: int = 6):
    return f"SELECT {index}, " + ", ".join(f"{rnd(v, digits)} AS {v}" for v in values.split(", ")) + f" FROM ({sql})"


SHAPES = ({"k0": 24}, {"k0": 8, "k1": 6}, {"k0": 4, "k1": 5, "k2": 6})
COORDS = ("x0", "x1", "x2")
POINTS = T.points_sql()


def _grid(spark, shape):
    df = N._with_modes(spark.range(1).select(F.lit(1).alias("_o")), shape).drop("_o")
    x = sum((F.col(a) * (3 * k + 2) for k, a in enumerate(shape)), F.lit(0)).cast("double")
    return df.withColumn("re", F.sin(x)).withColumn("im", F.cos(2 * x))


def _grid_sql(shape):
    x = "(" + " + ".join(f"{a} * {3 * k + 2}" for k, a in enumerate(shape)) + ")::DOUBLE"
    return f"SELECT {', '.join(shape)}, sin({x}) AS re, cos(2 * {x}) AS im FROM " + ", ".join(f"(SELECT range AS {a} FROM range({n}))" for a, n in shape.items())


def scattered(spark, sf_dir):
    """pid, x0, x1, x2, re, im: customers at multiples of irrational numbers, with values of about one."""
    c = T.table(spark, sf_dir, "customer")
    part = lambda k: F.col("c_custkey") * F.lit(math.sqrt(k)) - F.floor(F.col("c_custkey") * F.lit(math.sqrt(k)))
    return c.select(F.col("c_custkey").alias("pid"), part(2).alias("x0"), part(3).alias("x1"), part(5).alias("x2"), (F.col("c_acctbal") / 100000).alias("re"), (F.pmod("c_custkey", F.lit(7)) / 100 - 0.03).alias("im"))


_part = lambda k: f"c_custkey * {math.sqrt(k)!r}::DOUBLE - floor(c_custkey * {math.sqrt(k)!r}::DOUBLE)"
SCATTERED = f"SELECT c_custkey AS pid, {_part(2)} AS x0, {_part(3)} AS x1, {_part(5)} AS x2, c_acctbal / 100000 AS re, (c_custkey % 7) / 100.0::DOUBLE - 0.03::DOUBLE AS im FROM customer"


for _d, _shape in enumerate(SHAPES, 1):
    _coords = list(COORDS[:_d])
    _turn = " + ".join(f"({a} - {n // 2}) * {c}" for (a, n), c in zip(_shape.items(), _coords, strict=True))
    _index = ", ".join(_shape)
    _c, _s = f"cos({TAU} * ({_turn}))", f"sin({TAU} * ({_turn}))"
    _to = f"SELECT {_index}, sum(re * {_c} + im * {_s}) AS re, sum(im * {_c} - re * {_s}) AS im FROM ({POINTS}), " + ", ".join(f"(SELECT range AS {a} FROM range({n}))" for a, n in _shape.items()) + f" GROUP BY {_index}"
    _from = f"SELECT pid, sum(g.re * {_c} - g.im * {_s}) AS re, sum(g.im * {_c} + g.re * {_s}) AS im FROM ({POINTS}) p, ({_grid_sql(_shape)}) g GROUP BY pid"
    _add(f"nufft_nu2u_{_d}d", lambda s, d, c=_coords, sh=_shape: N.nu2u(T.points(s, d), c, sh, True, 1.0), _out(_to, _index, "re, im"))
    _add(f"nufft_u2nu_{_d}d", lambda s, d, c=_coords, sh=_shape: N.u2nu(_grid(s, sh), sh, T.points(s, d), c, "pid", False, 1.0), _out(_from, "pid", "re, im"))
    # customers at places that lie on no lattice; values of about one and 1e-11 of accuracy leave six digits that agree
    _to = _to.replace(f"({POINTS})", f"({SCATTERED})")
    _from = _from.replace(f"({POINTS})", f"({SCATTERED})")
    _add(f"nufft_nu2u_{_d}d_spread", lambda s, d, c=_coords, sh=_shape: N.nu2u_spread(scattered(s, d), c, sh, 1e-11, True, 1.0), _out(_to, _index, "re, im", 6), 6)
    _add(f"nufft_u2nu_{_d}d_spread", lambda s, d, c=_coords, sh=_shape: N.u2nu_spread(_grid(s, sh), sh, scattered(s, d), c, "pid", 1e-11, False, 1.0), _out(_from, "pid", "re, im", 6), 6)


def _baselines(spark, sf_dir):
    p = T.points(spark, sf_dir)
    return p.select(F.col("pid").alias("row"), (F.col("x0") * 900 - 450).alias("u"), (F.col("x1") * 900 - 450).alias("v"), (F.col("x2") * 300 - 150).alias("w"))


BASE = f"SELECT pid AS row, x0 * 900 - 450 AS u, x1 * 900 - 450 AS v, x2 * 300 - 150 AS w, re, im FROM ({POINTS})"
CHAN = "(SELECT range AS chan, 1e8::DOUBLE * (1 + range) AS freq FROM range(2))"
NPIX, SIZE = (8, 6), (0.02, 0.03)
_channels = lambda s: s.range(2).select(F.col("id").alias("chan"), (1e8 * (1 + F.col("id"))).alias("freq"))


def _vis(spark, sf_dir):
    p = T.points(spark, sf_dir)
    return p.crossJoin(_channels(spark)).select(F.col("pid").alias("row"), "chan", "re", "im", (1 + F.col("chan") / 2).alias("wgt"), ((F.col("pid") + F.col("chan")) % 3 != 0).alias("mask"))


VIS = f"SELECT row, chan, u * freq / {G.LIGHT!r}::DOUBLE AS u, v * freq / {G.LIGHT!r}::DOUBLE AS v, w * freq / {G.LIGHT!r}::DOUBLE AS w, re, im, 1 + chan / 2.0::DOUBLE AS wgt, (row + chan) % 3 <> 0 AS mask FROM ({BASE}), {CHAN}"
PIX = f"SELECT ix, iy, x, y, sqrt(1 - x * x - y * y) - 1 AS nm1 FROM (SELECT a.range AS ix, b.range AS iy, (a.range - {NPIX[0] / 2}::DOUBLE) * {SIZE[0]}::DOUBLE AS x, (b.range - {NPIX[1] / 2}::DOUBLE) * {SIZE[1]}::DOUBLE AS y FROM range({NPIX[0]}) a, range({NPIX[1]}) b)"
ANGLE = f"({TAU} * (u * x + v * y - w * nm1))"
DIRTY = f"SELECT ix, iy, sum(wgt * (re * cos({ANGLE}) - im * sin({ANGLE}))) / (any_value(nm1) + 1) AS value FROM ({VIS}) q, ({PIX}) WHERE mask GROUP BY ix, iy"
_add("wgridder_vis2dirty", lambda s, d: G.vis2dirty(_baselines(s, d), _channels(s), _vis(s, d), NPIX, SIZE), _out(DIRTY, "ix, iy", "value"))
_add("wgridder_vis2dirty_faceted", lambda s, d: G.vis2dirty_faceted(_baselines(s, d), _channels(s), _vis(s, d), NPIX, SIZE, 2, 2), _out(DIRTY, "ix, iy", "value"))
IMAGE = "sin((ix * 3 + iy)::DOUBLE)"
PREDICT = f"SELECT row, chan, sum(CASE WHEN mask THEN wgt ELSE 0 END * {IMAGE} / (nm1 + 1) * cos({ANGLE})) AS re, -sum(CASE WHEN mask THEN wgt ELSE 0 END * {IMAGE} / (nm1 + 1) * sin({ANGLE})) AS im FROM ({VIS}) q, ({PIX}) GROUP BY row, chan"


def _image(spark):
    return N._with_modes(spark.range(1), {"ix": NPIX[0], "iy": NPIX[1]}).select("ix", "iy", F.sin((F.col("ix") * 3 + F.col("iy")).cast("double")).alias("value"))


_add("wgridder_dirty2vis", lambda s, d: G.dirty2vis(_baselines(s, d), _channels(s), _image(s), NPIX, SIZE, _vis(s, d)), _out(PREDICT, "row, chan", "re, im"))
_add("wgridder_vis2dirty_spread", lambda s, d: G.vis2dirty_spread(_baselines(s, d), _channels(s), _vis(s, d), NPIX, SIZE, 1e-11), _out(DIRTY, "ix, iy", "value", 4), 4)
_add("wgridder_dirty2vis_spread", lambda s, d: G.dirty2vis_spread(_baselines(s, d), _channels(s), _image(s), NPIX, SIZE, _vis(s, d), 1e-11), _out(PREDICT, "row, chan", "re, im", 5), 5)
_add("wgridder_w_histogram", lambda s, d: G.w_histogram(_baselines(s, d), _channels(s), _vis(s, d), 20), f"SELECT coalesce(least(floor((w - low) / (high - low) * 20), 19), 0)::BIGINT AS bin, count(*) AS n FROM (SELECT abs(w) AS w, min(abs(w)) OVER () AS low, max(abs(w)) OVER () AS high FROM ({VIS}) WHERE mask) GROUP BY 1")


def _quats(spark, sf_dir):
    k = F.col("s_suppkey").cast("double")
    return T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.sin(k).alias("x"), F.cos(2 * k).alias("y"), F.sin(3 * k).alias("z"), F.cos(5 * k).alias("w"))


QUATS = "SELECT s_suppkey AS i, sin(s_suppkey::DOUBLE) AS x, cos(2 * s_suppkey::DOUBLE) AS y, sin(3 * s_suppkey::DOUBLE) AS z, cos(5 * s_suppkey::DOUBLE) AS w FROM supplier"
_add("quat2ptg", lambda s, d: Q.quat2ptg(_quats(s, d)).select("i", "theta", "phi", "psi"), _out(f"SELECT i, 2 * atan2(sqrt(x * x + y * y), sqrt(z * z + w * w)) AS theta, atan2(z, w) - atan2(-x, y) AS phi, atan2(z, w) + atan2(-x, y) AS psi FROM ({QUATS})", "i", "theta, phi, psi"))
UNIT = f"SELECT i, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM ({QUATS}))"
_sign = "sign(CASE WHEN abs(w) > 1e-12 THEN w ELSE 1 END)"
_add("ptg2quat_round_trip", lambda s, d: Q.ptg2quat(Q.quat2ptg(_quats(s, d)).select("i", "theta", "phi", "psi")).select("i", *[(F.col(c) * F.signum(F.when(F.abs("w") > 1e-12, F.col("w")).otherwise(1.0))).alias(c) for c in "xyzw"]), _out(f"SELECT i, x * {_sign} AS x, y * {_sign} AS y, z * {_sign} AS z, w * {_sign} AS w FROM ({UNIT})", "i", "x, y, z, w"))


def _pointing(spark, sf_dir):
    q = _quats(spark, sf_dir)
    count = q.count()
    return Q.rotated_quaternions(spark, q, count, 0.0, 1.0, 0.25, 2.0, (0.0, 0.0, 0.0, 1.0), True, 3 * count)


COUNT = "(SELECT count(*) FROM supplier)"
SLERP = f"SELECT n AS i, f, a.x AS x, a.y AS y, a.z AS z, a.w AS w, b.x AS x2, b.y AS y2, b.z AS z2, b.w AS w2, a.x * b.x + a.y * b.y + a.z * b.z + a.w * b.w AS dot FROM (SELECT range AS n, (0.25::DOUBLE + range / 2.0::DOUBLE) - floor(0.25::DOUBLE + range / 2.0::DOUBLE) AS f, floor(0.25::DOUBLE + range / 2.0::DOUBLE)::BIGINT % {COUNT} AS s FROM range(3 * {COUNT})) JOIN ({UNIT}) a ON a.i = s JOIN ({UNIT}) b ON b.i = (s + 1) % {COUNT}"
_mix = lambda c: f"(sin((1 - f) * o) * g * {c} + sin(f * o) * {c}2) / sin(o) AS {c}"
_add("pointing_provider", _pointing, _out(f"SELECT i, {', '.join(map(_mix, 'xyzw'))} FROM (SELECT *, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS g, acos(least(abs(dot), 1)) AS o FROM ({SLERP}))", "i", "x, y, z, w"))


def _deflect(spark, sf_dir):
    p = T.directions(spark, sf_dir)
    return Q.deflected_angles(p.select("id", "theta", "phi", (F.col("value") * 1e-5).alias("a_theta"), (F.sin(F.col("phi")) * 0.05).alias("a_phi"))).select("id", "theta_out", "phi_out", "gamma")


_D = f"SELECT id, theta, phi, a, b, sqrt(a * a + b * b) AS d FROM (SELECT id, theta, phi, value * 1e-5::DOUBLE AS a, sin(phi) * 0.05::DOUBLE AS b FROM ({T.directions_sql()}))"
_E = f"SELECT *, sin(theta) * cos(d) + cos(theta) * a * k AS nx, b * k AS ny, cos(theta) * cos(d) - sin(theta) * a * k AS nz, sin(theta) * a * v + cos(theta) * k AS t FROM (SELECT *, CASE WHEN d < 1e-4 THEN 1 - d * d / 6 ELSE sin(d) / d END AS k, CASE WHEN d < 1e-4 THEN -0.5 ELSE (cos(d) - 1) / (d * d) END AS v FROM ({_D}))"
_add("deflected_angles", _deflect, _out(f"SELECT id, atan2(sqrt(nx * nx + ny * ny), nz) AS theta_out, CASE WHEN atan2(ny, nx) + phi >= {TAU} THEN atan2(ny, nx) + phi - {TAU} ELSE atan2(ny, nx) + phi END AS phi_out, CASE WHEN d = 0 THEN 0 ELSE atan2(b * t, sin(theta) + a * t) END AS gamma FROM ({_E})", "id", "theta_out, phi_out, gamma", 5), 5)
_add("lensing_rotate", lambda s, d: Q.lensing_rotate(T.points(s, d), 2, "x0").select("pid", "re", "im"), _out(f"SELECT pid, re * cos(2 * x0) - im * sin(2 * x0) AS re, re * sin(2 * x0) + im * cos(2 * x0) AS im FROM ({POINTS})", "pid", "re, im"))

SIG = T.hourly_sql()
_two = lambda s, d: (T.hourly(s, d), T.hourly(s, d).withColumn("re", F.col("re") * F.cos(F.col("n").cast("double"))))
PAIR = f"SELECT re AS ar, im AS ai, re * cos(n::DOUBLE) AS br, im AS bi FROM ({SIG})"
_add("vdot", lambda s, d: M.vdot(*_two(s, d), ["n"]), f"SELECT round(sum(ar * br + ai * bi) / 1e6, 6) AS re, round(sum(ar * bi - ai * br) / 1e6, 6) + 0.0::DOUBLE AS im FROM ({PAIR})")
QUERIES["vdot"] = lambda s, d: rounded(M.vdot(*_two(s, d), ["n"]).select((F.col("re") / 1e6).alias("re"), (F.col("im") / 1e6).alias("im")))
_add("l2error", lambda s, d: M.l2error(*_two(s, d), ["n"]), f"SELECT round(sqrt(sum((ar - br) * (ar - br)) / greatest(sum(ar * ar + ai * ai), sum(br * br + bi * bi))), 6) AS l2error FROM ({PAIR})")
_add("gl_moments", lambda s, d: T.table(s, d, "lineitem").select(F.pmod(F.col("l_quantity").cast("long"), F.lit(21)).cast("long").alias("k")).distinct().crossJoin(M.gl_table(s, 12)).groupBy("k").agg(F.sum(F.col("weight") * F.pow(F.cos("theta"), F.col("k"))).alias("value")), "SELECT DISTINCT l_quantity::BIGINT % 21 AS k, CASE WHEN l_quantity::BIGINT % 21 % 2 = 0 THEN round(2.0::DOUBLE / (l_quantity::BIGINT % 21 + 1), 6) ELSE 0.0::DOUBLE END AS value FROM lineitem")
_add("integrate", lambda s, d: M.integrate(s, 20, 0.0, 2.0, "exp(-x) * x"), "SELECT round(1 - 3 * exp(-2.0::DOUBLE), 6) AS value")
_add("roll_resize_roll", lambda s, d: M.roll_resize_roll(T.real_grid(s, d), {"d": (12, 15, 4, -2), "h": (10, 7, -3, 1)}), _out(f"SELECT ((d + 4) % 12 + 13) % 15 AS d, ((h + 7) % 10 + 1) % 7 AS h, value FROM ({T.real_grid_sql()}) WHERE (h + 7) % 10 < 7", "d, h", "value"))
_add("scatter_add", lambda s, d: M.scatter_add(T.real_hourly(s, d), T.table(s, d, "lineitem").select((F.col("l_partkey") % 720).alias("n"), F.col("l_quantity").alias("value")), ["n"]), f"SELECT n, round(sum(value), 6) AS value FROM (SELECT n, value FROM ({T.real_hourly_sql()}) UNION ALL SELECT l_partkey % 720, l_quantity FROM lineitem) GROUP BY n")
_add("coloured_noise", lambda s, d: M.coloured_noise(T.table(s, d, "events"), "user_id", ["ts", "event_id"], "value", 0.1, 1e-4, 0.1, 10.0, -1.7).select("user_id", "event_id", "filtered"), None)
_l2, _l3 = "l_partkey % 5", "l_suppkey % 5"
TRIPLES = f"SELECT DISTINCT {_l2} AS l2, {_l3} AS l3, l_orderkey % (2 * ({_l2}) + 1) - ({_l2}) AS m2, (l_linenumber * 3) % (2 * ({_l3}) + 1) - ({_l3}) AS m3 FROM lineitem"
_triples = lambda s, d: T.table(s, d, "lineitem").select(*[F.expr(e).cast("long").alias(n) for e, n in ((_l2, "l2"), (_l3, "l3"), (f"l_orderkey % (2 * ({_l2}) + 1) - ({_l2})", "m2"), (f"(l_linenumber * 3) % (2 * ({_l3}) + 1) - ({_l3})", "m3"))]).distinct()
_fac = lambda x: f"gamma({x} + 1::DOUBLE)"


def _racah(rows):
    """Adds value: the 3j symbol (l1 l2 l3; -m2-m3 m2 m3) of rows (l1, l2, l3, m2, m3) by Racah's sum."""
    parts = ["t", "l3 - l2 + t - m2 - m3", "l3 - l1 + t - m2", "l1 + l2 - l3 - t", "l1 - t + m2 + m3", "l2 - t + m2"]
    roots = ["l1 + l2 - l3", "l1 - l2 + l3", "l2 + l3 - l1", "l1 - m2 - m3", "l1 + m2 + m3", "l2 + m2", "l2 - m2", "l3 + m3", "l3 - m3"]
    inside = " AND ".join(f"{p} >= 0" for p in parts)
    term = "CASE WHEN t % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / (" + " * ".join(_fac(f"greatest({p}, 0)") for p in parts) + ")"
    root = "sqrt(" + " * ".join(map(_fac, roots)) + f" / {_fac('l1 + l2 + l3 + 1')})"
    sign = "CASE WHEN abs(l1 - l2 - m3) % 2 = 0 THEN 1 ELSE -1 END"
    held = f"SELECT * FROM ({rows}) WHERE l1 BETWEEN abs(l2 - l3) AND l2 + l3 AND abs(m2 + m3) <= l1 AND abs(m2) <= l2 AND abs(m3) <= l3"
    return f"SELECT l1, l2, l3, m2, m3, {sign} * {root} * sum(CASE WHEN {inside} THEN {term} ELSE 0 END) AS value FROM ({held}), (SELECT range AS t FROM range(20)) GROUP BY l1, l2, l3, m2, m3"


_range = lambda name, a, b: f"(SELECT range AS {name} FROM range({a}, {b}))"
_every = f"SELECT * FROM {_range('l1', 0, 9)}, ({TRIPLES})"
_add("wigner3j", lambda s, d: M.wigner_table(_triples(s, d)), _out(_racah(_every), "l1, l2, l3, m2, m3", "value"))
_spectra = lambda s, d: T.table(s, d, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(9)).cast("long").alias("l")).agg((F.avg("l_quantity") / (10 * (1 + F.first(F.pmod("l_orderkey", F.lit(9)))))).cast("double").alias("value")).select(F.lit(0).cast("long").alias("ispec"), "l", "value")
SPECTRUM = "(SELECT (l_orderkey % 9)::BIGINT AS sl, (avg(l_quantity) / (10 * (1 + l_orderkey % 9)))::DOUBLE AS sv FROM lineitem GROUP BY l_orderkey % 9)"
_G = "((l1 + l2 + l) // 2)"
_W = f"gamma(2 * {_G} - 2 * l1 + 1) * gamma(2 * {_G} - 2 * l2 + 1) * gamma(2 * {_G} - 2 * l + 1) / gamma(2 * {_G} + 2) * pow(gamma({_G} + 1) / (gamma({_G} - l1 + 1) * gamma({_G} - l2 + 1) * gamma({_G} - l + 1)), 2)"
_add("coupling_matrix_00", lambda s, d: M.coupling_matrix(_spectra(s, d), 4, ["00"]), f"SELECT 0::BIGINT AS ispec, '00' AS kind, l1, l2, round(sum((2 * l + 1) / (4 * {PI}::DOUBLE) * sv * {_W}), 6) AS value FROM (SELECT range AS l1 FROM range(5)), (SELECT range AS l2 FROM range(5)), (SELECT sl AS l, sv FROM {SPECTRUM}) WHERE l1 <= l2 AND l BETWEEN l2 - l1 AND l1 + l2 AND (l1 + l2 + l) % 2 = 0 GROUP BY l1, l2")
_zero = _racah(f"SELECT l AS l1, l1 AS l2, l2 AS l3, m2, -m2 AS m3 FROM {_range('l', 0, 9)}, {_range('l1', 0, 5)}, {_range('l2', 0, 5)}, (SELECT unnest([0, -2]) AS m2) WHERE l1 <= l2")
_w = f"SELECT l1 AS l, l2 AS l1, l3 AS l2, sum(CASE WHEN m2 = 0 THEN value ELSE 0 END) AS w0, sum(CASE WHEN m2 <> 0 THEN value ELSE 0 END) AS w2 FROM ({_zero}) GROUP BY 1, 2, 3"
_kinds = " UNION ALL ".join(f"SELECT l, l1, l2, '{k}' AS kind, {v} AS w FROM ({_w})" for k, v in {"00": "w0 * w0", "02": "w0 * w2", "++": "CASE WHEN (l + l1 + l2) % 2 = 0 THEN w2 * w2 ELSE 0 END", "--": "CASE WHEN (l + l1 + l2) % 2 = 0 THEN 0 ELSE w2 * w2 END"}.items())
_add("coupling_matrix_spin2", lambda s, d: M.coupling_matrix(_spectra(s, d), 4), _out(f"SELECT 0::BIGINT AS ispec, kind, l1, l2, sum((2 * l + 1) / (4 * {PI}::DOUBLE) * sv * w) AS value FROM ({_kinds}) k JOIN {SPECTRUM} ON sl = l GROUP BY kind, l1, l2", "ispec, kind, l1, l2", "value"))
_pure_spectra = lambda s, d: _spectra(s, d).crossJoin(s.createDataFrame([("00", 1.0), ("02", 0.7), ("20", -0.4), ("22", 2.0)], "kind string, f double")).select("ispec", "kind", "l", (F.col("value") * F.col("f")).alias("value"))
_orders = "(SELECT * FROM (VALUES (0, 0), (-2, 2), (-2, 1), (-2, 0)) o(m2, m3))"
_symbols = _racah(f"SELECT l AS l1, b AS l2, a AS l3, m2, m3 FROM {_range('l', 0, 9)}, {_range('a', 0, 5)}, {_range('b', 0, 5)}, {_orders}")
_by_order = ", ".join(f"sum(CASE WHEN m2 = {p} AND m3 = {q} THEN value ELSE 0 END) AS {n}" for p, q, n in ((0, 0, "w0"), (-2, 2, "w2"), (-2, 1, "w1"), (-2, 0, "wz")))
_w = f"SELECT l1 AS l, l2 AS b, l3 AS a, {_by_order} FROM ({_symbols}) GROUP BY 1, 2, 3"
_pure = "w2 + CASE WHEN a > 1 THEN 2 * sqrt(l * (l + 1) / ((a - 1.0::DOUBLE) * (a + 2))) * w1 + sqrt((l + 2) * (l + 1) * l * abs(l - 1) / ((a + 2) * (a + 1) * a * (a - 1.0::DOUBLE))) * wz ELSE 0 END"
_kinds = "(SELECT * FROM (VALUES ('00', 1.0::DOUBLE), ('02', 0.7::DOUBLE), ('20', -0.4::DOUBLE), ('22', 2.0::DOUBLE)) k(kind, f))"
_terms = f"SELECT a, b, kind, (2 * l + 1) * (2 * b + 1) / (4 * {PI}::DOUBLE) * sv * f * CASE kind WHEN '00' THEN w0 * w0 WHEN '22' THEN pure * pure ELSE w0 * pure END AS v FROM (SELECT *, {_pure} AS pure FROM ({_w}) WHERE (a + b + l) % 2 = 0) JOIN {SPECTRUM} ON sl = l, {_kinds}"
_add("coupling_matrix_pure", lambda s, d: M.pure_coupling_matrix(_pure_spectra(s, d), 4), _out(f"SELECT 0::BIGINT AS ispec, kind, a AS l1, b AS l2, sum(v) AS value FROM ({_terms}) GROUP BY kind, a, b", "ispec, kind, l1, l2", "value"))
_bits = " + ".join(f"((l_partkey >> {b}) & 1) * {1 << 2 * b} + ((l_suppkey >> {b}) & 1) * {2 << 2 * b}" for b in range(20))
_add("morton", lambda s, d: T.table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct().withColumn("code", M.morton(["l_partkey", "l_suppkey"])).withColumn("back", M.unmorton("code", 2, 1)), f"SELECT DISTINCT l_partkey, l_suppkey, {_bits} AS code, l_suppkey AS back FROM lineitem")
_vectors = lambda s, d: S.ang2vec(T.directions(s, d)).select("id", *[(F.col(c) * (1 + F.col("id") % 3)).alias(c) for c in "xyz"], F.lit(0.6).alias("p"), F.lit(0.0).alias("q"), F.lit(-0.8).alias("r"))
_add("ang2vec", lambda s, d: S.ang2vec(T.directions(s, d)).select("id", "x", "y", "z"), _out(f"SELECT id, sin(theta) * cos(phi) AS x, sin(theta) * sin(phi) AS y, cos(theta) AS z FROM ({T.directions_sql()})", "id", "x, y, z"))
_add("vec2ang", lambda s, d: S.vec2ang(_vectors(s, d)).select("id", F.cos("theta").alias("c"), F.sin("phi").alias("s")), _out(f"SELECT id, cos(theta) AS c, sin(phi) AS s FROM ({T.directions_sql()})", "id", "c, s"))
_add("v_angle", lambda s, d: S.v_angle(_vectors(s, d), "xyz", "pqr").select("id", "angle"), _out(f"SELECT id, acos(least(1, greatest(-1, 0.6::DOUBLE * sin(theta) * cos(phi) - 0.8::DOUBLE * cos(theta)))) AS angle FROM ({T.directions_sql()})", "id", "angle"))


_add("hilbert", lambda s, d: T.table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct().withColumn("code", V.hilbert(["l_partkey", "l_suppkey"], 20)).withColumn("back", V.unhilbert("code", 2, 20)["y"]), "SELECT a AS l_partkey, b AS l_suppkey, d AS code, b AS back FROM (" + T.curve_sql("SELECT DISTINCT l_partkey AS a, l_suppkey AS b, l_partkey AS x, l_suppkey AS y FROM lineitem", 20) + ")")


def _narrow(spark, sf_dir):
    """Customers' directions, drawn together around the north pole, as vectors."""
    return S.ang2vec(T.directions(spark, sf_dir).withColumn("theta", F.col("theta") / 5)).select("x", "y", "z")


def _circle(spark, sf_dir):
    return spark.createDataFrame([C.enclosing_circle(_narrow(spark, sf_dir))], "theta double, phi double, radius double")


_add("enclosing_circle", _circle, None)
