"""Sets of integers as tables of disjoint half-open ranges: ``lo`` (in) and ``hi`` (out), by ``keys``.

Ranges of both operands become starts and ends; running sums of these along the number line tell who covers each
stretch, and stretches of the same answer are joined. Sets of different keys never meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATIONS = {"or": lambda a, b: a | b, "and": lambda a, b: a & b, "andnot": lambda a, b: a & ~b, "xor": lambda a, b: a != b}


def _order(keys: Sequence[str]):
    return Window.partitionBy(*(keys or [F.lit(0)]))


def _stretches(events: DataFrame, keys: Sequence[str], inside: Column) -> DataFrame:
    """Ranges on which ``inside`` holds, from events ``x`` with the changes ``da`` and ``db`` of both cover counts."""
    merged = events.groupBy(*keys, "x").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    along = _order(keys).orderBy("x")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = merged.select(*keys, "x", F.sum("da").over(upto).alias("a"), F.sum("db").over(upto).alias("b")).withColumn("in", inside)
    changed = state.withColumn("was", F.coalesce(F.lag("in").over(along), F.lit(False))).where("in <> was")
    return changed.withColumn("hi", F.lead("x").over(along)).where("in").select(*keys, F.col("x").alias("lo"), "hi")


def _events(ranges: DataFrame, keys: Sequence[str], first: bool) -> DataFrame:
    one, none = F.lit(1), F.lit(0)
    whole = ranges.where("lo < hi")
    at = F.explode(F.array(F.struct(F.col("lo").alias("x"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("x"), F.lit(-1).alias("d"))))
    moved = whole.select(*keys, at.alias("e"))
    return moved.select(*keys, "e.x", (F.col("e.d") * (one if first else none)).alias("da"), (F.col("e.d") * (none if first else one)).alias("db"))


def normalise(ranges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Overlapping, touching, empty or repeated ranges as the fewest disjoint ones."""
    return _stretches(_events(ranges, keys, True), keys, F.col("a") > 0)


def combine(a: DataFrame, b: DataFrame, operation: str, keys: Sequence[str] = ()) -> DataFrame:
    """``or``, ``and``, ``andnot`` or ``xor`` of two sets."""
    inside = OPERATIONS[operation](F.col("a") > 0, F.col("b") > 0)
    return _stretches(_events(a, keys, True).unionByName(_events(b, keys, False)), keys, inside)


def complement(a: DataFrame, low: int, high: int, keys: Sequence[str] = ()) -> DataFrame:
    """What of [low, high) is not in the set; keys without any range have no row."""
    whole = a.select(*keys, F.lit(low).cast("long").alias("lo"), F.lit(high).cast("long").alias("hi")).distinct()
    return combine(whole, a, "andnot", keys)


def sizes(a: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of ranges and of integers of each set."""
    return normalise(a, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ranges"), F.sum(F.col("hi") - F.col("lo")).alias("n_values"))


def values(a: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each integer of the set as ``value``."""
    return normalise(a, keys).select(*keys, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("value"))


def from_values(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """The set of a column's integers."""
    x = F.col(column).cast("long")
    return normalise(df.where(F.col(column).isNotNull()).select(*keys, x.alias("lo"), (x + 1).alias("hi")), keys)


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of which the two sets share an integer."""
    return combine(a, b, "and", keys).select(*keys).distinct()


def contains(a: DataFrame, points: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``inside`` to each point: the last range that begins at or before it decides."""
    at = normalise(a, keys).select(*keys, F.col("lo").alias("_x"), F.col("hi").alias("_hi"), F.lit(0).alias("_kind"), F.lit(None).cast(points.schema[column].dataType).alias("_p"))
    asked = points.select(*keys, F.col(column).cast("long").alias("_x"), F.lit(None).cast("long").alias("_hi"), F.lit(1).alias("_kind"), F.col(column).alias("_p"))
    before = _order(keys).orderBy("_x", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = at.unionByName(asked).withColumn("_last", F.last("_hi", ignorenulls=True).over(before))
    return last.where("_kind = 1").select(*keys, F.col("_p").alias(column), F.coalesce(F.col("_x") < F.col("_last"), F.lit(False)).alias("inside"))


def _numbers(lo: str, hi: str) -> Column:
    return F.expr(f"CASE WHEN {lo} < {hi} THEN sequence({lo}, {hi} - 1) ELSE CAST(array() AS ARRAY<BIGINT>) END")


def to_uniq(ranges: DataFrame, order: int, keys: Sequence[str] = ()) -> DataFrame:
    """NEST ranges of depth ``order`` as the fewest whole cells, numbered 4**(depth + 1) + cell.

    At each depth from the first whose cells fit, a range holds the whole cells that the depth above has left at both
    ends. Integers that no pixel of that depth has, from 12 * 4**order on, stay cells of depth ``order``, a row each;
    their numbers are above those of all pixels. Negative integers raise.
    """
    end = 12 << 2 * order
    known = F.when(F.col("lo") >= 0, F.col("lo")).otherwise(F.raise_error(F.lit("cells are numbered from 0 on")))
    left = normalise(ranges, keys).withColumn("lo", known).withColumns({"_lo": F.least("lo", F.lit(end)), "_hi": F.least("hi", F.lit(end))})
    first = F.expr(f"greatest(0, {order} - (length(bin(_hi - _lo)) - 1) div 2)").cast("int")
    at = left.withColumn("_d", F.explode(F.sequence(first, F.lit(order)))).withColumn("_s", 2 * (order - F.col("_d")))
    at = at.withColumns({"_a": F.expr("-shiftright(-_lo, _s)"), "_b": F.expr("shiftright(_hi, _s)"), "_up": F.expr("-shiftright(-_lo, _s + 2)"), "_down": F.expr("shiftright(_hi, _s + 2)")})
    above = (F.col("_d") > 0) & (F.col("_up") < F.col("_down"))
    at = at.withColumns({"_up": F.when(above, F.col("_up") * 4).otherwise(F.col("_b")), "_down": F.when(above, F.col("_down") * 4).otherwise(F.col("_b"))})
    at = at.withColumns({"_x": F.greatest("lo", F.lit(end)), "_y": F.when(F.col("_d") == order, F.col("hi")).otherwise(F.lit(end))})
    cells = F.explode(F.concat(_numbers("_a", "_up"), _numbers("_down", "_b"), _numbers("_x", "_y")))
    return at.select(*keys, "_d", cells.alias("_cell")).select(*keys, (F.col("_cell") + F.expr("shiftleft(4L, 2 * _d)")).alias("uniq"))


def from_uniq(cells: DataFrame, order: int, keys: Sequence[str] = ()) -> DataFrame:
    """The inverse of ``to_uniq``."""
    depth = F.least(F.floor((F.length(F.bin("uniq")) - 1) / 2) - 1, F.lit(order)).cast("int")
    at = cells.withColumn("_d", depth).withColumn("_c", F.expr("uniq - shiftleft(4L, 2 * _d)")).withColumn("_s", F.expr(f"shiftleft(1L, 2 * ({order} - _d))"))
    return normalise(at.select(*keys, (F.col("_c") * F.col("_s")).alias("lo"), ((F.col("_c") + 1) * F.col("_s")).alias("hi")), keys)
