"""Repair of conversations: a shortest path of edits to a legal order of roles, by Dial's bucket queue.

Rows are sorted over the cluster by conversation and turn and cut into blocks of a bounded size, so that no task holds
a whole conversation's texts. A row comes down to one byte: the kind of its role and its fault. A conversation's bytes
meet in one task, a millionth of what a large one's texts take, as its answer, one letter a row, is one value anyway.
There, nodes are (row, state of the role pattern); keeping, giving another role, deleting and inserting are arcs whose
costs are at most seven. Distances to the end are found from the end back with a circle of eight buckets; then the arcs on
which the distance falls by the arc's cost are walked from the start, the least letter first. Each block gets its own
letters back and writes its part of the repaired text; parts of a cut conversation are hashed one after the other as they
stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import drop_staged, stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows and bytes of text of a block; a longer row stands alone.
BLOCK_ROWS, BLOCK_BYTES = 4_000, 4_000_000
#: Rows whose conversations are planned in one group, a byte each; a longer conversation adds its own.
ROWS_A_BUCKET = 20_000
BLANKS = " \t\n\x0b\x0c\r"

#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a. Kinds of role: s, u, a, other.
_AFTER_ROLE = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
#: What an inserted or changed role must be in each state, and the state after it.
_NEXT_ROLE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
_ENDS = (0, 3)
FINE, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)


def distances(codes: bytes) -> np.ndarray:
    """Least cost from every (row, state) to the end, for rows given as kind of role + 4 * fault. Costs beyond reach are large."""
    n = len(codes)
    far = 1 << 30
    out = np.full(4 * (n + 1), far, np.int64) if n > 5000 else [far] * (4 * (n + 1))
    circle: list[list[int]] = [[] for _ in range(8)]
    for q in _ENDS:
        out[4 * n + q] = 0
        circle[0].append(4 * n + q)
    # arcs that end in a state, read backwards
    same_row = {q: [p for p in range(4) if _NEXT_ROLE[p][1] == q] for q in range(4)}
    kept = {(role, q): [p for p in range(4) if _AFTER_ROLE.get((p, role)) == q] for role in range(4) for q in range(4)}
    waiting, cost = len(_ENDS), 0
    while waiting:
        bucket = circle[cost & 7]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if out[node] != cost:
                continue
            row, q = node >> 2, node & 3
            arcs = [(4 * row + p, INSERT) for p in same_row[q]]
            if row:
                code, base = codes[row - 1], 4 * (row - 1)
                role, fault = code & 3, code >> 2
                arcs.append((base + q, DELETE))
                if fault not in (IS_BLANK, IS_DUPLICATE):
                    more = TRUNCATED if fault == IS_TRUNCATED else 0
                    arcs += [(base + p, KEEP + more) for p in kept[role, q]]
                    arcs += [(base + p, REROLE + more) for p in same_row[q]]
            for other, step in arcs:
                if cost + step < out[other]:
                    out[other] = cost + step
                    circle[cost + step & 7].append(other)
                    waiting += 1
        cost += 1
    return np.asarray(out)


def walk(codes: bytes, dist: np.ndarray) -> tuple[str, list[int]]:
    """The letters of the cheapest edits that come first in ASCII order, and how many letters there are before each row's own (and all)."""
    held, letters, starts, row, q = dist.tolist(), [], [], 0, 0
    n, fresh = len(codes), True
    while True:
        if fresh:
            starts.append(len(letters))
            fresh = False
        now = held[4 * row + q]
        if row == n and not now:
            return "".join(letters), starts
        after, take = _NEXT_ROLE[q][1], None
        if row < n:
            role, fault = codes[row] & 3, codes[row] >> 2
            if now == DELETE + held[4 * row + 4 + q]:
                letters.append("D")
                row, fresh = row + 1, True
                continue
        if now == INSERT + held[4 * row + after]:
            letters.append("I")
            q = after
            continue
        more = TRUNCATED if fault == IS_TRUNCATED else 0
        take = _AFTER_ROLE.get((q, role))
        if take is not None and now == KEEP + more + held[4 * row + 4 + take]:
            letters.append("K")
            q = take
        else:
            letters.append("R")
            q = after
        row, fresh = row + 1, True


def repaired_lines(roles: list[str], texts: list[str], letters: str, q: int) -> tuple[list[str], int]:
    """``role:text`` of the rows that stay or come in, for rows and their letters from state ``q`` on, and the state after them."""
    out, row = [], 0
    kinds = {"s": 0, "u": 1, "a": 2}
    for letter in letters:
        role, after = _NEXT_ROLE[q]
        if letter == "I":
            out.append(f"{role}:")
            q = after
            continue
        if letter == "R":
            out.append(f"{role}:{texts[row]}")
            q = after
        elif letter == "K":
            out.append(f"{roles[row]}:{texts[row]}")
            q = _AFTER_ROLE[q, kinds[roles[row][0]]]
        row += 1
    return out, q


def key_of(conv_id: Column) -> Column:
    """A conversation's id as text, in which null is a value of its own."""
    return F.when(conv_id.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), conv_id.cast("string")))


def damaged(conversations: DataFrame) -> DataFrame:
    """_conv, turn, role, text and copies of the rows as the checksum of conversation and turn leaves them."""
    blank = F.lit(" ")
    words = {c: F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn", "role", "text")}
    h = F.crc32(F.concat(words["conv_id"], F.lit(":"), words["turn"]).cast("binary")) % 20
    rows = conversations.select(key_of(F.col("conv_id")).alias("_conv"), F.col("turn").cast("long").alias("turn"), words["role"].alias("role"), words["text"].alias("text"), h.alias("_h")).where("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("_conv", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_h") == 3, 2).otherwise(1).alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies and the faults of the first copy and of the others."""
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    counted = rows.groupBy("_conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("_when", when)
    first = counted.groupBy("_conv", "role", "text").agg(F.min("_when").alias("_first"))
    met = counted.join(first, ["_conv", "role", "text"])
    shown = F.rtrim("text", F.lit(BLANKS))
    blank, last = F.length(shown) == 0, F.substring(shown, -1, 1)
    later = F.when(blank, IS_BLANK).otherwise(IS_DUPLICATE)
    fault = F.when(blank, IS_BLANK).when(~F.col("_when").eqNullSafe(F.col("_first")), IS_DUPLICATE).when(~last.isin(".", "!", "?"), IS_TRUNCATED).otherwise(FINE)
    kind = F.substring("role", 1, 1)
    kind = F.when(kind == "s", 0).when(kind == "u", 1).when(kind == "a", 2).otherwise(3)
    return met.select("_conv", "turn", "role", "text", "copies", (kind + 4 * fault).cast("int").alias("code"), (kind + 4 * later).cast("int").alias("later"))


_BLOCKED = "_conv string, role string, text string, copies long, code int, later int, part long, block long, place long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the blocks of a task's sorted rows. A block ends between conversations if it can, and within one if it must."""
    from pyspark import TaskContext

    part, block, rows, size, place, before = TaskContext.get().partitionId(), 0, 0, 0, 0, None
    for batch in batches:
        blocks, places = [], []
        lengths = pa.compute.binary_length(batch.column("text")).to_pylist()
        for conv, copies, length in zip(batch.column("_conv").to_pylist(), batch.column("copies").to_pylist(), lengths, strict=True):
            full = rows >= BLOCK_ROWS or size >= BLOCK_BYTES
            if rows and (full or conv != before and (rows >= BLOCK_ROWS // 2 or size >= BLOCK_BYTES // 2)):
                block, rows, size = block + 1, 0, 0
            rows, size, place, before = rows + copies, size + length * copies, place + 1, conv
            blocks.append(block)
            places.append(place)
        n = batch.num_rows
        columns = [batch.column(c) for c in ("_conv", "role", "text", "copies", "code", "later")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int64()), pa.array(blocks, pa.int64()), pa.array(places, pa.int64())], names=["_conv", "role", "text", "copies", "code", "later", "part", "block", "place"])


def _runs(values: list) -> Iterator[tuple[int, int]]:
    start = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[start]:
            yield start, k
            start = k


def _codes(table: pa.Table) -> pa.Table:
    """The bytes of each conversation of a block, a byte for each copy of a row."""
    table = table.sort_by("place")
    conv, copies, code, later = (table.column(c).to_pylist() for c in ("_conv", "copies", "code", "later"))
    names, out = [], []
    for a, b in _runs(conv):
        names.append(conv[a])
        out.append(b"".join([bytes([code[k]]) + bytes([later[k]]) * (copies[k] - 1) for k in range(a, b)]))
    n = len(names)
    part, block = (table.column(c)[0].as_py() for c in ("part", "block"))
    return pa.table({"_conv": pa.array(names, pa.string()), "part": pa.array([part] * n, pa.int64()), "block": pa.array([block] * n, pa.int64()), "codes": pa.array(out, pa.binary())})


_PLAN = "_conv string, part long, block long, pieces long, letters string, state int, blank long, duplicate long, truncated long, illegal long, cost long"


def _plan(table: pa.Table) -> pa.Table:
    """The letters of some conversations, cut where their blocks are cut."""
    table = table.sort_by([("_conv", "ascending"), ("part", "ascending"), ("block", "ascending")])
    conv, every = table.column("_conv").to_pylist(), table.column("codes").to_pylist()
    out: dict[str, list] = {c: [] for c in ("pieces", "letters", "state", "blank", "duplicate", "truncated", "illegal", "cost")}
    for a, b in _runs(conv):
        codes = every[a:b]
        whole = b"".join(codes)
        dist = distances(whole)
        letters, starts = walk(whole, dist)
        state, row = 0, 0
        illegal = _illegal(whole)
        faults = [whole.count(bytes([4 * f + r])) for f in range(4) for r in range(4)]
        for k, piece in enumerate(codes):
            last = row + len(piece)
            own = letters[starts[row] : starts[last] if k + 1 < len(codes) else None]
            values = (b - a, own, state, sum(faults[4:8]), sum(faults[8:12]), sum(faults[12:]), illegal, int(dist[0]))
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
            if k + 1 < len(codes):
                state = _state_after(piece, own, state)
            row = last
    kinds = {"letters": pa.string(), "state": pa.int32()}
    return pa.table({c: table.column(c) for c in ("_conv", "part", "block")} | {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def _illegal(codes: bytes) -> int:
    """Neighbours whose roles are not system and user, user and assistant, or assistant and user."""
    roles = codes.translate(_ROLE)
    return max(0, len(codes) - 1) - sum(roles.count(pair) for pair in (b"\x00\x01", b"\x01\x02", b"\x02\x01"))


_ROLE = bytes(b & 3 for b in range(256))


def _state_after(codes: bytes, letters: str, q: int) -> int:
    row = 0
    for letter in letters:
        if letter in "IR":
            q = _NEXT_ROLE[q][1]
        elif letter == "K":
            q = _AFTER_ROLE[q, codes[row] & 3]
        row += letter != "I"
    return q


_WRITTEN = "_conv string, part long, block long, pieces long, audit string, n_lines long, sha string, chunk binary, blank long, duplicate long, truncated long, illegal long, cost long"


def _written(rows: pa.Table, plan: pa.Table) -> pa.Table:
    """A block's repaired texts: the checksum of a conversation that is whole, else the text."""
    rows, out = rows.sort_by("place"), []
    plans = {p["_conv"]: p for p in plan.to_pylist()}
    conv, copies = rows.column("_conv").to_pylist(), rows.column("copies").to_pylist()
    for a, b in _runs(conv):
        p = plans[conv[a]]
        repeat = [k for k in range(a, b) for _ in range(copies[k])]
        roles, texts = rows.column("role").take(repeat).to_pylist(), rows.column("text").take(repeat).to_pylist()
        lines, _ = repaired_lines(roles, texts, p["letters"], p["state"])
        data = "\n".join(lines).encode()
        whole = p["pieces"] == 1
        out.append({**{c: p[c] for c in ("_conv", "part", "block", "pieces", "blank", "duplicate", "truncated", "illegal", "cost")}, "audit": p["letters"], "n_lines": len(lines), "sha": hashlib.sha256(data).hexdigest() if whole else None, "chunk": None if whole else data})
    kinds = {"_conv": pa.string(), "audit": pa.string(), "sha": pa.string(), "chunk": pa.binary()}
    names = [c.split()[0] for c in _WRITTEN.split(", ")]
    return pa.table({c: pa.array([r[c] for r in out], kinds.get(c, pa.int64())) for c in names})


_SUMMARY = "_conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes the parts of cut conversations, which come in order, as they stream by; only letters are kept."""
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
    held, last, done = None, None, []

    def close() -> None:
        if last is not None:
            done.append([last["_conv"], *[last[c] for c in names[1:6]], "".join(held[0]), held[1].hexdigest()])

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            if last is None or row["_conv"] != last["_conv"]:
                close()
                held = ([], hashlib.sha256(), [0])
            last = row
            held[0].append(row["audit"])
            if row["n_lines"]:
                if held[2][0]:
                    held[1].update(b"\n")
                held[1].update(row["chunk"])
                held[2][0] += row["n_lines"]
        if done:
            yield batch_of(done)
            done.clear()
    close()
    if done:
        yield batch_of(done)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows are damaged by checksum first (see ``damaged``), nulls in conversation, turn, role and text count as one space
    there. Rows go by turn, null turns first; rows of one turn go by role and text in code-point order, and equal ones are
    repeats. A role is taken by its first letter; one of none of s, u and a cannot be kept. A null conv_id is a
    conversation of its own. Very long conversations are cut into blocks, texts of any length are read whole. A
    conversation without rows after the damage has zeros, an empty audit and the checksum of nothing. Extra columns are
    not looked at; an empty table gives an empty result.
    """
    rows = stage(damaged(conversations), "repair-damaged")
    order = ["_conv", F.col("turn").asc_nulls_first(), "role", "text"]
    faulty = with_faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    blocked = stage(faulty.drop("turn").mapInArrow(_blocks, _BLOCKED), "repair-blocks")
    codes = blocked.drop("role", "text").groupBy("part", "block").applyInArrow(_codes, "_conv string, part long, block long, codes binary")
    buckets = max(1, blocked.count() // ROWS_A_BUCKET)
    plan = codes.groupBy(F.pmod(F.xxhash64("_conv"), F.lit(buckets)).alias("_bucket")).applyInArrow(_plan, _PLAN)
    written = blocked.groupBy("part", "block").cogroup(plan.groupBy("part", "block")).applyInArrow(_written, _WRITTEN)
    written = stage(written, "repair-written")
    whole = written.where("pieces = 1").select("_conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
    cut = written.where("pieces > 1").repartition("_conv").sortWithinPartitions("_conv", "part", "block").mapInArrow(_joined, _SUMMARY)
    turns = rows.groupBy("_conv").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    found = whole.unionByName(cut).join(turns, "_conv")
    every = conversations.select("conv_id", key_of(F.col("conv_id")).alias("_conv")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast(LongType()).alias(c)
    out = every.join(found, "_conv", "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
    out = stage(out, "repair-result")
    drop_staged(rows, blocked, written)
    return out
