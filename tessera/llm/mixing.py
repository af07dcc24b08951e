"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a seeded shuffle, repeated at most ``cap`` times. What is queued is an entry:
a whole document, or a part of it of at most ``QUANTUM`` words. An entry's virtual finish time is the number of words
that its source has queued up to its end, divided by the source's weight. All entries are range-sorted by finish time,
ties by the shuffle, and cut where their running total of words reaches the budget; the entry at the cut is taken in
part, or as a whole where documents are. A source whose queue runs dry has no more entries, so its share goes to the
others by their weights. A source misses its target by at most an entry.

The sort needs no window over all rows: only the totals of its ranges are added up, and the range that the budget falls
into is added up by itself. Entries that start so late that the cut cannot reach them are not sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, drop_staged, packed, running_total, stage, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
SEED = 17
#: Words of an entry where documents are served in parts.
QUANTUM = 256


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, budget: int | None = None) -> DataFrame:
    """Per source its weight, its target in words and the virtual time at which the budget is spent.

    ``totals`` has one row per source: ``source``, ``source_size``. Weights repeat over the sources by code point, null
    last. Sources without words get the target 0. The budget is all words where it is None.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = totals.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") - 1) % len(weights) + 1))
    room = F.col("source_size").cast("double") * cap
    ranked = ranked.withColumn("_dry", room / F.col("weight"))
    by_dry = everything.orderBy("_dry", "_rank")
    total = F.sum("source_size").over(everything).cast("double")
    wanted = total if budget is None else F.least(F.lit(float(budget)), total * cap)
    before = F.coalesce(F.sum(room).over(by_dry.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    live = F.sum("weight").over(by_dry.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumn("_level", (wanted - before) / live)
    # the first queue that outlasts its own level; later ones only raise the level's estimate
    fits = F.when(F.col("_level") <= F.col("_dry") * (1 + 1e-12), F.struct("_dry", "_rank", "_level"))
    ranked = ranked.withColumn("spent_at", F.coalesce(F.min(fits).over(everything)["_level"], F.lit(0.0)))
    return ranked.select("source", "source_size", "weight", "spent_at", F.least(room, F.col("weight") * F.col("spent_at")).alias("target"))


def _finish(turn: Column, end: Column) -> Column:
    """Virtual time at which a row's words up to ``end`` are served in its source's pass ``turn``."""
    return (turn * F.col("source_size") + F.col("_before") + end) / F.col("weight")


_ORDER = ("v_finish", "_h", "doc_id", "turn", "nth")


def served_order(queued: DataFrame, cap: int, quantum: int | None, late: float) -> DataFrame:
    """The entries (v_finish, _h, doc_id, turn, nth, words), range-sorted; ``_range`` numbers the ranges in order."""
    size = F.col("size") if quantum is None else F.lit(quantum)
    turns = queued.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("turn"))
    turns = turns.where(_finish(F.col("turn"), F.lit(0)) <= F.lit(late))
    entries = turns.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("size") / size))).alias("nth"))
    start, end = (F.col("nth") - 1) * size, F.least(F.col("nth") * size, F.col("size"))
    entries = entries.where(_finish(F.col("turn"), start) <= F.lit(late))
    entries = entries.select(_finish(F.col("turn"), end).alias("v_finish"), "_h", "doc_id", "turn", "nth", (end - start).alias("words"))
    return entries.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("_range", F.spark_partition_id())


def cut_at(order: DataFrame, budget: int) -> tuple | None:
    """The first entry at which the running total of words reaches the budget, and the words served before it; None if none does."""
    sums = sorted(tuple(r) for r in order.groupBy("_range").agg(F.sum("words")).collect())  # two numbers for each range
    before = 0
    for part, words in sums:
        if before + words >= budget:
            running = F.sum("words").over(Window.partitionBy("_range").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            inside = order.where(F.col("_range") == part).withColumn("_upto", running + F.lit(before)).where(F.col("_upto") >= budget)
            row = inside.orderBy(*_ORDER).first()
            return *[row[k] for k in _ORDER], row["words"], row["_upto"] - row["words"]
        before += words
    return None


def schedule(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, budget: int | None = None, seed: int = SEED, whole: bool = False, with_row: bool = True) -> DataFrame:
    """One row per input row: ``_row`` (its columns), doc_id, size, source_size, target and ``passes``.

    ``passes`` holds, for each time the document may be served, its pass, virtual start and finish and the words taken.
    With ``whole`` documents are entries, and the one at the cut is taken as a whole when at least half of it lies before
    the cut. Null text and null source are allowed, documents without words are never served, whole texts are counted
    at any length; repeated rows are documents of their own; an empty table gives an empty result. Reruns agree: the
    order is a seeded hash of the row.
    """
    text = F.col("text")
    own = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": word_count(text), "_h": F.xxhash64(F.lit(seed), F.col("doc_id"), text)}
    sized = stage(packed(docs, **own) if with_row else docs.select(*[v.alias(k) for k, v in own.items()]), "mix-sized")
    per_source = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n")), "mix-totals")
    rows, words = per_source.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    level = targets(per_source.drop("_n"), weights, cap, budget)
    largest, spent_at = sized.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0], (level.agg(F.max("spent_at")).first()[0] or 0.0)
    queued = running_total(sized, ["source"], "_h", F.col("size"), "_before", bucket_bits(rows), ["doc_id", "size"])
    level = level.select(F.col("source").alias("_s"), "source_size", "weight", "target")
    queued = queued.join(level, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    queued = stage(queued, "mix-queued")
    quantum = None if whole else QUANTUM
    longest = largest if whole else min(largest, QUANTUM)
    late = spent_at + (longest + 1) / min(weights) + 1e-9 * spent_at
    order = stage(served_order(queued.select("_h", "doc_id", "size", "_before", "source_size", "weight"), cap, quantum, late), "mix-order")
    wanted = int(words if budget is None else min(budget, words * cap))
    cut = cut_at(order, wanted) if wanted > 0 else None
    drop_staged(order, sized)

    size = F.col("size") if whole else F.lit(QUANTUM)

    def one(turn: Column) -> Column:
        at = turn * F.col("source_size") + F.col("_before")

        def words_of(nth: Column) -> Column:
            return F.least(nth * size, F.col("size")) - (nth - 1) * size

        def taken(nth: Column) -> Column:
            if wanted <= 0:
                return F.lit(0).cast("long")
            if cut is None:
                return words_of(nth)
            key = F.struct(_finish(turn, F.least(nth * size, F.col("size"))).alias("a"), F.col("_h").alias("b"), F.col("doc_id").alias("c"), turn.alias("d"), nth.alias("e"))
            kinds = ("double", "long", queued.schema["doc_id"].dataType.simpleString(), "int", "long")
            edge = F.struct(*[F.lit(v).cast(kind).alias(n) for v, kind, n in zip(cut, kinds, "abcde", strict=False)])
            rest = wanted - cut[6]
            part = (cut[5] if 2 * rest >= cut[5] else 0) if whole else rest
            return F.when(key < edge, words_of(nth)).when(key == edge, F.lit(int(part)).cast("long")).otherwise(F.lit(0).cast("long"))

        entries = F.when(F.col("size") > 0, F.sequence(F.lit(1).cast("long"), F.ceil(F.col("size") / size))).otherwise(F.array().cast("array<long>"))
        total = F.aggregate(entries, F.lit(0).cast("long"), lambda held, nth: held + taken(nth))
        total = F.when(at / F.col("weight") <= F.lit(late), total).otherwise(F.lit(0).cast("long"))
        return F.struct(turn.alias("turn"), (at / F.col("weight")).alias("v_start"), ((at + F.col("size")) / F.col("weight")).alias("v_finish"), total.alias("taken"))

    passes = F.array(*[one(F.lit(k)) for k in range(cap)])
    return queued.select(*(["_row"] if with_row else []), "doc_id", "size", "source_size", "target", passes.alias("passes"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The served entries in order of virtual finish time: all input columns and ``mix`` (turn, v_start, v_finish, taken)."""
    served = schedule(docs, **options).select("_row", "doc_id", F.explode("passes").alias("mix")).where("mix.taken > 0")
    return served.orderBy("mix.v_finish", "doc_id", "mix.turn").select("_row.*", "mix")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the input's columns; a document served more than once appears as often."""
    served = schedule(docs, whole=True, **options).select("_row", F.explode("passes").alias("mix")).where("mix.taken > 0")
    return served.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def words_taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of each row; see ``schedule`` for nulls, ties and empty tables."""
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda total, x: total + x["taken"])
    return schedule(docs, with_row=False, **options).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
