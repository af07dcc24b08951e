"""Grouping of spelling variants: words one edit apart, by rolling hashes of words with a letter taken out.

Two words differ by one replaced letter if they are equal when both lose the letter at that place, and by one inserted
letter if one of them equals the other without some letter. The hash of a word is the sum of its letters' values times
powers of an odd number, modulo 2**64, so that hashes of all prefixes and suffixes are two running sums, and the hash
without any letter follows from them for a whole Arrow batch at once. Keys are dealt out by their leading bits; each
part is sorted, and rows whose key stands alone, the most, go. The others get their words, and those of one key are told
apart by the strings themselves. Words of one key and place are all near each other, so a group says for each of its
words how many there are and which occurs most, in one row; no pairs are made. A group is not larger than the alphabet
times the word, whatever the words' counts are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage
from .words import mix

#: Runs of these are words.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Every so many-th word loses a letter, by checksum.
DAMAGE = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Keys of one part of the first sort, and rows with words of one part of the second.
KEYS_A_PART, ROWS_A_PART = 400_000, 100_000
#: Letters that are worked on at once.
BATCH_LETTERS = 1 << 18

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def occurrences(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts, with letters lost by checksum, that have enough letters and occurrences."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("_run"))
    runs = runs.where(F.length("_run") >= LEAST_LETTERS).withColumn("_run", F.translate("_run", upper, upper.lower()))
    h = F.crc32(F.concat("_d", F.lit(":"), "_run").cast("binary"))
    at = (h % F.length("_run")).cast("int")
    word = F.when(h % DAMAGE == 0, F.concat(F.expr("substring(_run, 1, _at)"), F.expr("substring(_run, _at + 2)"))).otherwise(F.col("_run"))
    held = runs.withColumn("_at", at).select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word and letter: the word's number, the letter's place, the hash without it, and whether it differs from
    the letter before (of a run of equal letters, the first stands for all); each word as a whole follows, with place -1."""
    flat = "".join(words.to_pylist())
    size = np.array([len(w) for w in words.to_pylist()], np.int64)
    letters = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - first[word]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[_U(1), np.full(int(size.max(initial=0)), _ODD, np.uint64)], dtype=np.uint64)
        value = mix(letters + _U(0xD1342543DE82EF95))
        run = np.r_[_U(0), np.cumsum(value * powers[place], dtype=np.uint64)]
        prefix = run[:-1] - run[first][word]
        suffix = run[(first + size)[word]] - run[1:]
        key = prefix + suffix * _U(_INVERSE)
        whole = run[first + size] - run[first]
        key, whole = mix(key + (size - 1).astype(np.uint64)[word] * _U(0xA0761D6478BD642F)), mix(whole + size.astype(np.uint64) * _U(0xA0761D6478BD642F))
    fresh = (place == 0) | (letters != np.r_[_U(0), letters[:-1]])
    n = np.arange(len(size))
    return np.r_[word, n], np.r_[place, np.full(len(n), -1)], np.r_[key, whole], np.r_[fresh, np.ones(len(n), bool)]


def _part(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _keys(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(np.array([len(w) for w in batch.column(1).to_pylist()], np.int64))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + BATCH_LETTERS, "right")))
            some = batch.slice(low, high - low)
            word, place, key, fresh = deletion_keys(some.column(1))
            ids = some.column(0).to_numpy()[word]
            yield pa.RecordBatch.from_arrays([pa.array(_part(key, bits)), pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(fresh), pa.array(ids)], names=["part", "key", "place", "fresh", "id"])
            low = high


def _shared(table: pa.Table) -> pa.Table:
    """The rows of a part whose key is of use: several words lose the same place, or a whole word is another less a letter."""
    key, place, fresh = table.column("key").to_numpy(), table.column("place").to_numpy(), table.column("fresh").to_numpy(zero_copy_only=False)
    order = np.lexsort((place, key))
    k, p = key[order], place[order]
    same = np.r_[False, (k[1:] == k[:-1]) & (p[1:] == p[:-1])] if len(k) else np.zeros(0, bool)
    replaced = same | np.r_[same[1:], False] if len(k) else same
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    group = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1 if len(k) else head
    whole, loses = np.zeros(len(head), bool), np.zeros(len(head), bool)
    whole[group[p < 0]] = True
    loses[group[(p >= 0) & fresh[order]]] = True
    both = (whole & loses)[group]
    keep = np.sort(order[(replaced & (p >= 0)) | (both & ((p < 0) | fresh[order]))])
    return table.select(["key", "place", "fresh", "id"]).take(pa.array(keep))


def _best(members: list[tuple[int, str, int]]) -> tuple[tuple[int, str, int], tuple[int, str, int] | None]:
    """The two of most occurrences, of smallest spelling among equals, of (-n, word, id)."""
    first = min(members)
    return first, min((m for m in members if m is not first), default=None)


def _near(table: pa.Table) -> pa.Table:
    """For each word of a group: how many near words the group has, and the one of most occurrences."""
    groups: dict[tuple[int, str], tuple[list, dict[int, list]]] = {}
    columns = [table.column(c).to_pylist() for c in ("key", "place", "fresh", "id", "word", "n")]
    for key, place, fresh, i, word, n in zip(*columns, strict=True):
        left = word if place < 0 else word[:place] + word[place + 1 :]
        wholes, by_place = groups.setdefault((key, left), ([], {}))
        (wholes if place < 0 else by_place.setdefault(place, [])).append((-n, word, i, fresh))
    out: list[tuple[int, int, int, str, int]] = []
    for wholes, by_place in groups.values():
        for rows in by_place.values():  # one letter replaced by another
            if len(rows) > 1:
                members = [r[:3] for r in rows]
                first, second = _best(members)
                for m in members:
                    top = second if m is first else first
                    out.append((m[2], len(members) - 1, -top[0], top[1], top[2]))
        for w in wholes:  # one letter more
            longer = [r[:3] for rows in by_place.values() for r in rows if r[3]]
            if longer:
                top = min(longer)
                out.append((w[2], len(longer), -top[0], top[1], top[2]))
                out += [(r[2], 1, -w[0], w[1], w[2]) for r in longer]
    kinds = (("id", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string()), ("best_id", pa.int64()))
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(kinds, columns, strict=True)})


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, best_n, best, best_id of the words (id, word, n) that have a near one."""
    total = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(1, total / KEYS_A_PART))))
    keys = words.select("id", "word").mapInArrow(lambda b: _keys(b, bits), "part long, key long, place int, fresh boolean, id long")
    shared = stage(keys.groupBy("part").applyInArrow(_shared, "key long, place int, fresh boolean, id long"), "variant-keys")
    met = shared.join(words, "id").withColumn("_part", F.pmod(F.shiftrightunsigned("key", 20), F.lit(max(1, shared.count() // ROWS_A_PART))))
    found = met.groupBy("_part").applyInArrow(_near, "id long, n_near long, best_n long, best string, best_id long")
    best = F.min(F.struct((-F.col("best_n")).alias("o"), "best", "best_id"))
    out = stage(found.groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("id", "n_near", (-F.col("b.o")).alias("best_n"), F.col("b.best").alias("best"), F.col("b.best_id").alias("best_id")), "variant-near")
    drop_staged(shared)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """id, root of every row of ``forms`` (id, form): the last that can be reached by following forms.

    Each round every word jumps to where its present target points, so rounds grow as the logarithm of the longest chain,
    which itself is at most the logarithm of the largest count, as a form occurs twice as often at least.
    """
    state = stage(forms.select("id", F.col("form").alias("root")), "variant-roots")
    while True:
        onward = state.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        jumped = stage(state.join(onward, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "variant-roots")
        drop_staged(state)
        moved, state = not jumped.where("_moved").isEmpty(), jumped.select("id", "root")
        state._staged_at = jumped._staged_at
        if not moved:
            return state


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, form, root, n_near and form_n of every word of at least five letters that occurs three times or more.

    Runs of letters of whole texts are words, of which only A-Z is lower-cased; where 97 divides the checksum of doc_id
    and word, one letter is lost. Words are near if one inserted, lost or replaced letter makes one of the other. The
    form of a word is the near word of most occurrences (of equals the first in code-point order), if these are at least
    twice its own, else null; the root is the last of the chain of forms, or the word itself. A null text has no words;
    a null doc_id counts as an empty one in the checksum; repeated rows count as often as they stand; texts and words of
    any length are read whole; extra columns are not looked at; an empty table gives an empty result.
    """
    words = stage(occurrences(docs).withColumn("id", F.monotonically_increasing_id()), "variant-words")
    near = near_words(words)
    joined = words.join(near, "id", "left").withColumn("_form", F.col("best_n") >= 2 * F.col("n"))
    forms = near.join(words.select("id", "n"), "id").where(F.col("best_n") >= 2 * F.col("n")).select("id", F.col("best_id").alias("form"))
    last = roots(forms)
    ends = last.join(words.select(F.col("id").alias("root"), F.col("word").alias("_root")), "root").select("id", "_root")
    kept = lambda c: F.when(F.col("_form"), F.col(c))
    return joined.join(ends, "id", "left").select("word", kept("best").alias("form"), F.coalesce("_root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), kept("best_n").alias("form_n"))


