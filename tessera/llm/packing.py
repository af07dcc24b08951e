"""Packing documents into windows of 2048 tokens by non-negative least squares over length combinations.

Lengths are counted in units of 32 tokens. A document's ids are cut into full windows, one piece of 1 to 63 whole
units, and a crumb of fewer than 32 tokens. Combinations of up to three piece lengths that fill a window exactly are
enumerated; non-negative least squares against the histogram of lengths says how often each is used. The counts are
rounded down and the residual histogram is packed greedily: first by further exact combinations, then by cutting what
is left into powers of two, which fill windows exactly when laid out by falling size. Crumbs are laid end to end and
cut at the windows' ends. What does not fill a last window is cut into sequences whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, running_total, stage
from .tokens import END_ID, tokenizer

WINDOW = 2048
UNIT = 32
DEPTH = 3


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of up to ``depth`` lengths, longest first, that add up to ``units``."""
    out = []
    for n in range(1, depth + 1):
        for head in combinations_with_replacement(range(units, 0, -1), n - 1):
            last = units - sum(head)
            if 1 <= last <= (head[-1] if head else units):
                out.append((*head, last))
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares with no negative part, by an active set: the most promising column enters, negative ones leave."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = np.where(used, -np.inf, a.T @ (b - a @ x))
        best = int(np.argmax(gain))
        if gain[best] <= slack:
            break
        used[best] = True
        while True:
            trial = np.zeros_like(x)
            trial[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            bad = used & (trial <= 0)
            if not bad.any():
                break
            step = float(np.min(x[bad] / np.maximum(x[bad] - trial[bad], 1e-300)))
            x = x + step * (trial - x)
            used &= ~(bad & (x <= 1e-12))
            x[~used] = 0
            if not used.any():
                return x
        x = trial
    return x


def repeat_counts(histogram: np.ndarray, options: list[tuple[int, ...]]) -> np.ndarray:
    """How often each combination is used: least squares, rounded down, then further exact fills while lengths last."""
    a = np.zeros((len(histogram), len(options)))
    for j, lengths in enumerate(options):
        for n in lengths:
            a[n, j] += 1
    scale = max(1.0, float(histogram.max(initial=0)))
    wanted = np.floor(nnls(a, histogram / scale) * scale + 1e-6).astype(np.int64)
    left, counts = histogram.astype(np.int64).copy(), np.zeros(len(options), np.int64)
    for limit in (wanted, np.full(len(options), np.iinfo(np.int64).max)):
        for j in np.argsort(-wanted, kind="stable"):
            need = a[:, j].astype(np.int64)
            fits = min(int(limit[j]), *(int(left[n] // need[n]) for n in set(options[j])))
            if fits > 0:
                counts[j] += fits
                left -= fits * need
    return counts


def power_cuts(rest: int) -> list[int]:
    """Ends of the pieces of ``rest`` whose lengths are its powers of two, longest first."""
    ends, at = [], 0
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            ends.append(at := at + (1 << bit))
    return ends


def _cut(batches: Iterator[pa.RecordBatch], path: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """A row per document with the checksums of all places it may be cut into; only crumbs keep their ids."""
    words, end = tokenizer(path), np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            rows = []
            for key, text in zip(batch.column(0).slice(low, 1000).to_pylist(), batch.column(1).slice(low, 1000), strict=True):
                ids = words.encode(text.as_py()) + end
                n = len(ids) // 4
                full, units = n // WINDOW, n % WINDOW // UNIT
                at = full * WINDOW
                crcs = [zlib.crc32(ids[4 * WINDOW * k : 4 * WINDOW * (k + 1)]) for k in range(full)]
                ends = [at, *(at + UNIT * e for e in power_cuts(units))]
                parts = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
                rows.append((key, n, crcs, units, zlib.crc32(ids[4 * at : 4 * (at + UNIT * units)]), parts, ids[4 * (at + UNIT * units) :], ids if keep_ids else None))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n", "crcs", "units", "crc", "parts", "crumb", "ids"])


def _crumb_pieces(batches: Iterator[pa.RecordBatch], total: int, first: int) -> Iterator[pa.RecordBatch]:
    """Cuts the stream of crumbs at the windows' ends and, in the last window, at its powers of two."""
    last, ends = total // WINDOW, power_cuts(total % WINDOW)
    for batch in batches:
        rows = []
        for key, n, crumb, at in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            begin, size = at, len(crumb) // 4
            while begin < at + size:
                window, offset = divmod(begin, WINDOW)
                low, high, nth = 0, WINDOW, 0
                if window == last:
                    nth = sum(e <= offset for e in ends)
                    low, high = ([0, *ends])[nth], ends[nth]
                stop = min(at + size, window * WINDOW + high)
                rows.append((key, n - size + begin - at, stop - begin, zlib.crc32(crumb[4 * (begin - at) : 4 * (stop - at)]), n, first + window + nth, offset - low))
                begin = stop
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``keep_ids`` its ids.

    A null text is empty and has the end id alone; a null doc_id stays null, and repeated rows are documents of their own,
    told apart by their place among equal ones. Texts of any length are cut into as many pieces as they need; extra columns
    are not looked at; an empty table gives an empty result. Pieces of a sequence are gapless from offset 0; each sequence is full or a power of two long.
    """
    spark, units = docs.sparkSession, WINDOW // UNIT
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = "doc_id long, n long, crcs array<long>, units int, crc long, parts array<long>, crumb binary, ids binary"
    cut = stage(texts.mapInArrow(lambda batches: _cut(batches, tokenizer_path, keep_ids), schema), "packing-cut")
    cut = cut.withColumn("_h", F.xxhash64("doc_id", "n", "crc", "crumb"))
    crumb = (F.length("crumb") / 4).cast("long")
    totals = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("crcs")), F.lit(0)), F.coalesce(F.sum(crumb), F.lit(0))).first()
    rows, fulls, crumbs = (int(v) for v in totals)
    histogram = np.zeros(units + 1, np.int64)  # at most 63 numbers come back
    for k, count in cut.groupBy("units").count().collect():
        histogram[k] = count
    histogram[0], histogram[units] = 0, fulls
    options = combinations(units)
    counts = repeat_counts(histogram, options)
    bits = bucket_bits(rows)
    ties = ["doc_id", "n"]

    # full windows
    whole = running_total(cut.where(F.size("crcs") > 0), [], "_h", F.size("crcs").cast("long"), "_rank", bits, ties)
    whole = whole.select("doc_id", "n", "ids", "_rank", F.posexplode("crcs").alias("_nth", "ids_crc32"))
    out = [whole.select("doc_id", (F.col("_nth") * F.lit(WINDOW)).cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.col("_rank") + F.col("_nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")]

    # pieces of whole units, by the combinations; the rules are bounded by the number of combinations
    rules, free, base = [], np.zeros(units + 1, np.int64), fulls
    for lengths, times in zip(options, counts, strict=True):
        if not times or lengths == (units,):
            continue
        for n in set(lengths):
            offsets = [sum(lengths[:i]) for i, m in enumerate(lengths) if m == n]
            rules.append((int(n), int(free[n]), int(free[n] + times * len(offsets)), int(base), offsets))
            free[n] += times * len(offsets)
        base += int(times)
    ranked = running_total(cut.where("units > 0"), ["units"], "_h", F.lit(1).cast("long"), "_rank", bits, ties)
    start = F.col("n") - F.col("n") % WINDOW
    table = spark.createDataFrame(rules, "_k int, _low long, _high long, _base long, _offsets array<long>")
    placed = ranked.join(F.broadcast(table), (F.col("units") == F.col("_k")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    nth = F.col("_rank") - F.col("_low")
    slots = F.size("_offsets")
    offset = F.element_at("_offsets", (nth % slots + 1).cast("int")) * UNIT
    out.append(placed.select("doc_id", start.alias("start"), (F.col("units") * F.lit(UNIT)).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("_base") + F.floor(nth / slots)).cast("long").alias("sequence_id"), offset.alias("offset"), "ids"))

    # pieces that no combination takes, as powers of two by falling size
    left = histogram - free
    left[units] = 0
    part_base: dict[tuple[int, int], int] = {}
    at = 0
    for bit in range(units.bit_length() - 2, -1, -1):
        for k in range(1, units):
            if k >> bit & 1:
                part_base[k, bit] = at
                at += int(left[k]) << bit
    parts = [(k, pos, bit, part_base[k, bit], int(free[k]), sum(1 << b for b in range(bit + 1, 7) if k >> b & 1)) for k in range(1, units) for pos, bit in enumerate(b for b in range(6, -1, -1) if k >> b & 1)]
    table = spark.createDataFrame(parts, "_k int, _pos int, _bit int, _base long, _free long, _skip long")
    loose = ranked.join(F.broadcast(table), (F.col("units") == F.col("_k")) & (F.col("_rank") >= F.col("_free")))
    size = F.expr("shiftleft(1L, _bit)")
    place = F.col("_base") + (F.col("_rank") - F.col("_free")) * size
    window, inside, last, ends = F.floor(place / units), place % units, at // units, power_cuts(at % units)
    low, turn = F.lit(0).cast("long"), F.lit(0).cast("long")
    for nth_end, e in enumerate(ends[:-1]):
        low, turn = F.when(inside >= e, F.lit(e).cast("long")).otherwise(low), F.when(inside >= e, F.lit(nth_end + 1).cast("long")).otherwise(turn)
    is_last = window == last
    pick: Column = F.element_at("parts", F.col("_pos") + 1)
    out.append(loose.select("doc_id", (start + F.col("_skip") * UNIT).alias("start"), (size * UNIT).alias("length"), pick.alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.lit(base) + window + F.when(is_last, turn).otherwise(F.lit(0))).cast("long").alias("sequence_id"), ((inside - F.when(is_last, low).otherwise(F.lit(0))) * UNIT).cast("long").alias("offset"), "ids"))
    base += at // units + len(ends)

    # crumbs, end to end
    laid = running_total(cut.where(crumb > 0), [], "_h", crumb, "_rank", bits, ties)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if keep_ids:
        kept = laid.select("doc_id", "n", "crumb", "_rank", "ids")
        pieces = kept.mapInArrow(lambda batches: _with_ids(batches, crumbs, base), schema + ", ids binary")
    else:
        pieces = laid.select("doc_id", "n", "crumb", "_rank").mapInArrow(lambda batches: _crumb_pieces(batches, crumbs, base), schema).withColumn("ids", F.lit(None).cast("binary"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    result = None
    for piece in out:
        piece = piece.withColumn("ids", F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))"))
        result = piece if result is None else result.unionByName(piece)
    result = result.unionByName(pieces)
    return result if keep_ids else result.select(*columns)


def _with_ids(batches: Iterator[pa.RecordBatch], total: int, first: int) -> Iterator[pa.RecordBatch]:
    """The pieces of crumbs with the ids that belong to them."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            ids = one.column(4)[0].as_py()
            for out in _crumb_pieces(iter([one.select(one.schema.names[:4])]), total, first):
                own = [ids[4 * a : 4 * (a + n)] for a, n in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(own, pa.binary())], names=[*out.schema.names, "ids"])


def sequences(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """sequence_id, n_tokens and the ids of each sequence as little-endian 32-bit bytes."""
    pieces = pack_documents(docs, tokenizer_path, keep_ids=True)
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), held.alias("_held"))
    joined = F.aggregate("_held", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return whole.select("sequence_id", "n_tokens", joined.alias("ids"))
