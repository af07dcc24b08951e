"""Removing passages that an earlier document holds, by windows of words behind a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document. Every window falls on one cell in each of ``DEPTH`` rows of
a sketch, so a cell counts at least as many windows as any of its own. The sketch grows with the input and is never in
one place: it is cut into slices of cells. Documents are dealt to groups of about ``BYTES_PER_GROUP``; a group sends
each slice the sorted cells that it met, as gaps, and whether it met them more than once. A slice adds up its lists,
with counts that stop at two, and answers each list with one bit a cell: whether the cell reached two. A window can
only be repeated if all of its cells did.

In the second pass the groups send just these windows, each once with the first document of the group that holds it, to
ranges of the windows' hashes. There they are grouped by 128 bits, from two hashes of each word whose keys come from a
digest of all texts, so that no window can be made to meet another's, and the groups that hold a window
also in a later document get its first document back. The third pass removes words by these answers. A window that
a third of all documents hold is sent once by each group, so it needs no task of its own; no range or slice is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import corpus_seeds
from .words import keyed_hashes, mix, portions, window_hashes

WINDOW = 13
DEPTH = 2
#: Cells of a row for each byte of text: about seven for each window.
CELLS_PER_BYTE = 1.0
#: Base-2 logarithms of the cells of a slice, at least and at most, and of the slices of a row where both allow it.
SLICE_BITS_LEAST, SLICE_BITS_MOST, ROW_SLICES_BITS = 16, 26, 8
#: Bytes of text for a group of documents and for a range of windows.
BYTES_PER_GROUP = 4_000_000
BYTES_PER_RANGE = 32_000_000

_U = np.uint64
Seeds = Sequence[int]


def cell_bits(n_bytes: int) -> int:
    """Base-2 logarithm of the cells of a row for so many bytes of text; grows with the input without a bound."""
    return max(SLICE_BITS_LEAST, math.ceil(math.log2(max(1.0, n_bytes * CELLS_PER_BYTE))))


def slice_bits(bits: int) -> int:
    """Base-2 logarithm of the cells of a slice: about 2**ROW_SLICES_BITS slices a row, until a slice is as large as a task may hold."""
    return min(bits, SLICE_BITS_MOST, max(SLICE_BITS_LEAST, bits - ROW_SLICES_BITS))


def cells(windows: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(windows + _U((row + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> _U(64 - bits)).astype(np.int64)


def _windows(column: pa.Array, n: int, seeds: Seeds, second: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each window of a batch, its document's number, its first word among the batch's words, and each document's first word."""
    words, first = keyed_hashes(column, seeds if second else seeds[:1])
    counts = np.maximum(0, np.diff(first) - n + 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(doc)) + np.repeat(first[:-1] - np.cumsum(counts) + counts, counts)
    other = window_hashes(words[1], n, 7)[at] if second else np.zeros(0, np.uint64)
    return window_hashes(words[0], n)[at], other, doc, at, first


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _known(texts: pa.Table) -> pa.Table:
    """The rows whose document has an id."""
    ids = _column(texts, "_doc")
    return texts.filter(ids.is_valid()) if ids.null_count else texts


def _group_windows(texts: pa.Table, n: int, seeds: Seeds, second: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes and the doc_id of all windows of a group."""
    texts = _known(texts)
    column, ids = _column(texts, "_text"), _column(texts, "_doc").to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [(np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64))]
    for low, count in portions(column):
        h1, h2, doc, _, _ = _windows(column.slice(low, count), n, seeds, second)
        parts.append((h1, h2, ids[low + doc]))
    h1, h2, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h1, h2, doc


def _table(**columns: tuple[list, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(values, kind) for k, (values, kind) in columns.items()})


def encode_cells(at: np.ndarray, more: np.ndarray) -> bytes:
    """Sorted distinct numbers as gaps of one, two or four bytes, with longer gaps apart, and a bit for each."""
    gaps = np.diff(at, prepend=0)
    mean = int(at[-1]) / len(at) if len(at) else 0
    width = 1 if mean < 60 else 2 if mean < 15_000 else 4
    top = (1 << 8 * width) - 1
    wide = gaps >= top
    return b"".join([bytes([width]), len(at).to_bytes(4, "little"), np.where(wide, top, gaps).astype(f"<u{width}").tobytes(), gaps[wide].astype("<u8").tobytes(), np.packbits(more).tobytes()])


def decode_cells(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, k = data[0], int.from_bytes(data[1:5], "little")
    gaps = np.frombuffer(data, f"<u{width}", k, 5).astype(np.int64)
    wide, at = gaps == (1 << 8 * width) - 1, 5 + width * k
    n_wide = int(wide.sum())
    gaps[wide] = np.frombuffer(data, "<u8", n_wide, at)
    return np.cumsum(gaps), np.unpackbits(np.frombuffer(data, np.uint8, -1, at + 8 * n_wide), count=k).astype(bool)


def _cells_met(texts: pa.Table, n: int, seeds: Seeds, bits: int, size: int) -> pa.Table:
    """For each slice that a group meets, the cells of it."""
    keys, lists = [], []
    windows = _group_windows(texts, n, seeds, second=False)[0]
    for row in range(DEPTH):
        met = cells(windows, row, bits)
        met.sort()
        head = np.flatnonzero(np.r_[True, met[1:] != met[:-1]]) if len(met) else np.zeros(0, np.int64)
        more = np.diff(np.r_[head, len(met)]) > 1
        met = met[head]
        part = met >> size
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            keys.append(row << (bits - size) | int(part[a]))
            lists.append(encode_cells(met[a:b] & ((1 << size) - 1), more[a:b]))
    group = texts.column("grp")[0].as_py()
    return _table(slice=(keys, pa.int64()), grp=([group] * len(keys), pa.int64()), cells=(lists, pa.binary()))


def _answers(lists: pa.Table, size: int) -> pa.Table:
    """Adds up a slice's lists and answers each with a bit for each of its cells; lists without a full cell get none."""
    once, twice = np.zeros(1 << size, bool), np.zeros(1 << size, bool)
    for data in lists.column("cells"):
        at, more = decode_cells(data.as_py())
        twice[at[more | once[at]]] = True
        once[at] = True
    groups, bits = [], []
    for group, data in zip(lists.column("grp").to_pylist(), lists.column("cells"), strict=True):
        full = twice[decode_cells(data.as_py())[0]]
        if full.any():
            groups.append(group)
            bits.append(np.packbits(full).tobytes())
    key = lists.column("slice")[0].as_py()
    return _table(grp=(groups, pa.int64()), slice=([key] * len(groups), pa.int64()), bits=(bits, pa.binary()))


def _passed(windows: np.ndarray, answers: pa.Table, bits: int, size: int) -> np.ndarray:
    """Whether all cells of each window reached two."""
    out = np.ones(len(windows), bool)
    held: dict[int, bytes] = dict(zip(answers.column("slice").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    for row in range(DEPTH):
        known, where = np.unique(cells(windows, row, bits), return_inverse=True)
        full = np.zeros(len(known), bool)
        for key, data in held.items():
            if key >> (bits - size) == row:
                part = key & ((1 << (bits - size)) - 1)
                a, b = np.searchsorted(known, [part << size, part + 1 << size])
                if len(data) != -(-(b - a) // 8):
                    raise ValueError("a group's texts differ from those it counted")
                full[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a)
        out &= full[where]
    return out


def _grouped(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal windows together, and where each window begins in it."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
    return order, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)


def encode_ids(ids: np.ndarray) -> bytes:
    """Whole numbers as the least one and the others' distances from it, in four bytes each if they fit."""
    least = int(ids.min(initial=0 if not len(ids) else ids[0]))
    away = (ids - np.int64(least)).view(np.uint64)  # a distance beyond 63 bits wraps around, and back
    wide = 4 if not len(ids) or int(away.max()) < 1 << 32 else 8
    return bytes([wide]) + least.to_bytes(8, "little", signed=True) + away.astype(f"<u{wide}").tobytes()


def decode_ids(data: bytes | pa.Buffer, at: int, k: int) -> tuple[np.ndarray, int]:
    """The numbers that stand in ``data`` from ``at`` on, and where they end."""
    view = memoryview(data)
    wide, least = view[at], np.int64(int.from_bytes(view[at + 1 : at + 9], "little", signed=True))
    return np.frombuffer(view, f"<u{wide}", k, at + 9).astype(np.uint64).view(np.int64) + least, at + 9 + wide * k


def _asked(texts: pa.Table, answers: pa.Table, n: int, seeds: Seeds, bits: int, size: int, range_bits: int) -> pa.Table:
    """The windows of a group that pass the sketch, for each range of hashes: the hashes, the first document and whether a later one holds it too."""
    keys, lists = [], []
    if texts.num_rows and answers.num_rows:
        h1, h2, doc = _group_windows(texts, n, seeds, second=True)
        at = np.flatnonzero(_passed(h1, answers, bits, size))
        h1, h2, doc = h1[at], h2[at], doc[at]
        order, head = _grouped(h1, h2)
        low, high = (np.minimum.reduceat(doc[order], head), np.maximum.reduceat(doc[order], head)) if len(head) else (doc, doc)
        h1, h2 = h1[order][head], h2[order][head]
        part = _range_of(h1, range_bits)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            keys.append(int(part[a]))
            lists.append(b"".join([int(b - a).to_bytes(4, "little"), h1[a:b].tobytes(), h2[a:b].tobytes(), encode_ids(low[a:b]), np.packbits(high[a:b] > low[a:b]).tobytes()]))
    group = texts.column("grp")[0].as_py() if texts.num_rows else 0
    return _table(range=(keys, pa.int64()), grp=([group] * len(keys), pa.int64()), windows=(lists, pa.binary()))


def _range_of(h1: np.ndarray, range_bits: int) -> np.ndarray:
    return (h1 >> _U(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(h1), np.int64)


def _firsts(lists: pa.Table) -> pa.Table:
    """The exact pass over a range: groups that hold a window in a later document than its first one get that document."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    sizes = []
    for block in lists.column("windows"):
        data = block.as_buffer()
        k = int.from_bytes(data[:4].to_pybytes(), "little")
        sizes.append(k)
        parts[0].append(np.frombuffer(data, "<u8", k, 4))
        parts[1].append(np.frombuffer(data, "<u8", k, 4 + 8 * k))
        ids, end = decode_ids(data, 4 + 16 * k, k)
        parts[2].append(ids)
        parts[3].append(np.unpackbits(np.frombuffer(data, np.uint8, -1, end), count=k).astype(bool))
    h1, h2, low, more = (np.concatenate(x) for x in parts)
    order, head = _grouped(h1, h2)
    first = np.empty(len(h1), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(low[order], head), np.diff(np.r_[head, len(h1)]))
    told = (first < low) | more
    groups, found, a = [], [], 0
    for group, k in zip(lists.column("grp").to_pylist(), sizes, strict=True):
        at = a + np.flatnonzero(told[a : a + k])
        a += k
        if len(at):
            groups.append(group)
            found.append(len(at).to_bytes(4, "little") + h1[at].tobytes() + h2[at].tobytes() + encode_ids(first[at]))
    return _table(grp=(groups, pa.int64()), firsts=(found, pa.binary()))


def _first_docs(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and first documents of a group's repeated windows, in order."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, _U)], [np.zeros(0, _U)], [np.zeros(0, np.int64)]]
    for block in answers.column("firsts"):
        data = block.as_buffer()
        k = int.from_bytes(data[:4].to_pybytes(), "little")
        for held, found in zip(parts, (np.frombuffer(data, "<u8", k, 4), np.frombuffer(data, "<u8", k, 4 + 8 * k), decode_ids(data, 4 + 16 * k, k)[0]), strict=True):
            held.append(found)
    h1, h2, first = (np.concatenate(x) for x in parts)
    order = np.lexsort((h2, h1))
    return h1[order], h2[order], first[order]


def _later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Numbers of the windows that a smaller document holds."""
    if not len(known[0]):
        return np.zeros(0, np.int64)
    left = np.searchsorted(known[0], h1)
    out: list[np.ndarray] = []
    at = np.flatnonzero(left < len(known[0]))
    left = left[at]
    while len(at):  # windows of one first hash follow each other; as a rule there is one
        same = known[0][left] == h1[at]
        at, left = at[same], left[same]
        hit = known[1][left] == h2[at]
        out.append(at[hit & (known[2][left] < doc[at])])
        at, left = at[~hit], left[~hit] + 1
        inside = left < len(known[0])
        at, left = at[inside], left[inside]
    return np.concatenate(out) if out else at


def _cut(texts: pa.Table, answers: pa.Table, n: int, seeds: Seeds, with_text: bool) -> pa.Table:
    """A group's texts without the words that a repeated window covers."""
    known, ids, column = _first_docs(answers), _column(texts, "_doc"), _column(texts, "_text")
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    counts, lost, shas, kept_texts = [], [], [], []
    for low, rows in portions(column):
        part = column.slice(low, rows)
        h1, h2, doc, at, first = _windows(part, n, seeds)
        marked = _later(h1, h2, numbers[low + doc], known)
        marked = at[marked[valid[low + doc[marked]]]]
        depth = np.bincount(marked, minlength=first[-1] + 1) - np.bincount(marked + n, minlength=first[-1] + 1)
        kept = np.cumsum(depth)[: first[-1]] == 0
        counts.append(np.diff(first))
        for k in range(rows):
            own, whole = kept[first[k] : first[k + 1]], part[k].as_py()
            words = whole.split()
            lost.append(gone := len(own) - int(np.count_nonzero(own)))
            left = b" ".join(compress(words, own.tolist()) if gone else words)
            shas.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept_texts.append((left if gone else whole).decode())
    return pa.table({
        "_row": _column(texts, "_row"), "n_words": pa.array(np.concatenate([np.zeros(0, np.int64), *counts])), "n_removed": pa.array(lost, pa.int64()),
        "kept_sha256": pa.array(shas, pa.string()), "kept_text": pa.array(kept_texts if with_text else [None] * len(lost), pa.string()),
    })


def repeated_windows(rows: DataFrame, n: int, n_bytes: int, seeds: Seeds) -> tuple[DataFrame, DataFrame]:
    """The answers of the sketch (grp, slice, bits) and of the exact pass (grp, firsts) to the groups of ``rows`` (_doc, _text, grp)."""
    bits = cell_bits(n_bytes)
    size, range_bits = slice_bits(bits), max(0, math.ceil(math.log2(max(1.0, n_bytes / BYTES_PER_RANGE))))
    met = rows.groupBy("grp").applyInArrow(lambda t: _cells_met(t, n, seeds, bits, size), "slice long, grp long, cells binary")
    answers = met.groupBy("slice").applyInArrow(lambda t: _answers(t, size), "grp long, slice long, bits binary")
    asked = rows.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(lambda a, b: _asked(a, b, n, seeds, bits, size, range_bits), "range long, grp long, windows binary")
    return answers, asked.groupBy("range").applyInArrow(lambda t: _firsts(t), "grp long, firsts binary")


def remove_repeats(docs: DataFrame, n: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Each input row as ``_row`` with n_words, n_removed, kept_sha256 and, with ``with_text``, kept_text.

    Words are parted by ASCII blanks and compared as they are. Each word covered by a window that also starts in a
    document of a smaller doc_id is removed; kept words are joined by one space, and a text that loses none stays as it
    is (its checksum is that of its words joined). Null text has no words (kept_text is empty). Rows of one doc_id do
    not count against each other; a row whose doc_id is null neither loses words nor causes a loss. Texts of any length
    are read whole. An empty table gives an empty result.
    """
    seeds, n_bytes = corpus_seeds(docs)
    groups = max(1, math.ceil(n_bytes / BYTES_PER_GROUP))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if with_text and c != "text" or c == "doc_id"])
    rows = docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("_doc"), text.alias("_text"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("_doc", "_text"), F.lit(groups)))
    _, firsts = repeated_windows(rows, n, n_bytes, seeds)
    schema = StructType([rows.schema["_row"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), StructField("kept_text", StringType())])
    return rows.groupBy("grp").cogroup(firsts.groupBy("grp")).applyInArrow(lambda a, b: _cut(a, b, n, seeds, with_text), schema)


def digest(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row; see ``remove_repeats`` for nulls, ties and empty tables."""
    return remove_repeats(docs, n, with_text=False).select("_row.doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents with their kept text; one that loses all its words goes. All columns stay, n_chars is counted anew."""
    cut = remove_repeats(docs, n).where("n_removed = 0 or n_removed < n_words")
    columns = {c: F.col(f"_row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return cut.select(*[columns[c].alias(c) for c in docs.columns])
