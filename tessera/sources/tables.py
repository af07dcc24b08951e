"""Arrays and point sets derived from the star-schema tables, in long form, for the registered queries.

Each function has an SQL text of the same rows beside it, for DuckDB.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First hour of the event stream and its length in hours.
EPOCH_US = 1_704_067_200_000_000
HOURS = 720
DAYS = 30
GOLDEN = (math.sqrt(5) - 1) / 2


def micros() -> Column:
    """Microseconds since the first hour; the table's timestamps have no zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str, n: int = HOURS) -> DataFrame:
    """signal(n, re, im): sum of event values, and their number over ten, by hour modulo ``n``."""
    hour = F.pmod(F.floor(micros() / 3_600_000_000), F.lit(n)).cast("long")
    return table(spark, sf_dir, "events").groupBy(hour.alias("n")).agg(F.sum("value").alias("re"), (F.count(F.lit(1)) / 10).alias("im"))


def hourly_sql(n: int = HOURS) -> str:
    return f"SELECT ((epoch_us(ts) - {EPOCH_US}) // 3600000000) % {n} AS n, sum(value) AS re, count(*) / 10.0 AS im FROM events GROUP BY 1"


def real_hourly(spark: SparkSession, sf_dir: str, n: int = HOURS) -> DataFrame:
    return hourly(spark, sf_dir, n).select("n", F.col("re").alias("value"))


def real_hourly_sql(n: int = HOURS) -> str:
    return f"SELECT n, re AS value FROM ({hourly_sql(n)})"


def prices(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """line(n, value): prices of all order lines in millions, summed by order number modulo ``n``."""
    return table(spark, sf_dir, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(n)).cast("long").alias("n")).agg((F.sum("l_extendedprice").cast("double") / 1e6).alias("value"))


def prices_sql(n: int) -> str:
    return f"SELECT (l_orderkey % {n})::BIGINT AS n, sum(l_extendedprice)::DOUBLE / 1e6 AS value FROM lineitem GROUP BY 1"


def grid(spark: SparkSession, sf_dir: str, days: int = 12, hours: int = 10) -> DataFrame:
    """grid(d, h, re, im): the same by day and hour, both wrapped to small sizes."""
    hour = F.floor(micros() / 3_600_000_000)
    d, h = F.pmod(F.floor(hour / 24), F.lit(days)).cast("long"), F.pmod(hour, F.lit(hours)).cast("long")
    return table(spark, sf_dir, "events").groupBy(d.alias("d"), h.alias("h")).agg(F.sum("value").alias("re"), (F.count(F.lit(1)) / 10).alias("im"))


def grid_sql(days: int = 12, hours: int = 10) -> str:
    hour = f"((epoch_us(ts) - {EPOCH_US}) // 3600000000)"
    return f"SELECT ({hour} // 24) % {days} AS d, {hour} % {hours} AS h, sum(value) AS re, count(*) / 10.0 AS im FROM events GROUP BY 1, 2"


def real_grid(spark: SparkSession, sf_dir: str, days: int = 12, hours: int = 10) -> DataFrame:
    return grid(spark, sf_dir, days, hours).select("d", "h", F.col("re").alias("value"))


def real_grid_sql(days: int = 12, hours: int = 10) -> str:
    return f"SELECT d, h, re AS value FROM ({grid_sql(days, hours)})"


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ptg(id, theta, phi, value): each customer at a point of a golden-angle spiral, with the account balance."""
    c = table(spark, sf_dir, "customer")
    z = F.lit(1.0) - (F.pmod("c_custkey", F.lit(1000)) * 2.0 + 1.0) / 1000.0
    turn = F.pmod("c_custkey", F.lit(1000)) * F.lit(GOLDEN)
    phi = (turn - F.floor(turn)) * F.lit(2 * math.pi)
    return c.select(F.col("c_custkey").alias("id"), F.acos(z).alias("theta"), phi.alias("phi"), F.col("c_acctbal").alias("value"))


def directions_sql() -> str:
    k = "(c_custkey % 1000)"
    return f"SELECT c_custkey AS id, acos(1.0::DOUBLE - ({k} * 2.0::DOUBLE + 1.0::DOUBLE) / 1000.0::DOUBLE) AS theta, ({k} * {GOLDEN!r}::DOUBLE - floor({k} * {GOLDEN!r}::DOUBLE)) * {2 * math.pi!r}::DOUBLE AS phi, c_acctbal AS value FROM customer"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points(pid, x0, x1, x2, re, im): one per supplier, irregular in the unit box."""
    s = table(spark, sf_dir, "supplier")
    part = lambda m, q: (F.pmod(F.col("s_suppkey") * m, F.lit(q)) / F.lit(float(q)))
    return s.select(F.col("s_suppkey").alias("pid"), part(37, 101).alias("x0"), part(53, 103).alias("x1"), part(71, 107).alias("x2"), (F.col("s_acctbal") / 1000).alias("re"), (F.pmod(F.col("s_suppkey"), F.lit(7)) - 3.0).alias("im"))


def points_sql() -> str:
    part = lambda m, q: f"((s_suppkey * {m}) % {q}) / {q}.0::DOUBLE"
    return f"SELECT s_suppkey AS pid, {part(37, 101)} AS x0, {part(53, 103)} AS x1, {part(71, 107)} AS x2, s_acctbal / 1000 AS re, (s_suppkey % 7) - 3.0::DOUBLE AS im FROM supplier"


def curve_sql(rows: str, bits: int) -> str:
    """Adds ``d`` to rows (a, b, x, y): the number along the curve, by the well-known loop over squares of halved sides."""
    turn = lambda own, other: f"CASE WHEN (y >> k) & 1 = 1 THEN {own} WHEN (x >> k) & 1 = 1 THEN {(1 << bits) - 1} - {other} ELSE {other} END"
    more = "(CASE WHEN (x >> k) & 1 = 0 THEN (y >> k) & 1 ELSE 3 - ((y >> k) & 1) END)::BIGINT << (2 * k)"
    return f"WITH RECURSIVE h(a, b, x, y, k, d) AS (SELECT a, b, x::BIGINT, y::BIGINT, {bits - 1}, 0::BIGINT FROM ({rows}) UNION ALL SELECT a, b, {turn('x', 'y')}, {turn('y', 'x')}, k - 1, d + ({more}) FROM h WHERE k >= 0) SELECT a, b, d FROM h WHERE k < 0"
