"""Words and shingles of whole texts as 64-bit hashes, computed for an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, to bound the memory of a task; a longer text stands alone.
PORTION = 1 << 20

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: Parts words at every ASCII character but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Keeps the first 0 to 8 bytes of eight.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary or string column's bytes and its offsets in them, without a copy; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return held, at - at[0]


def spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each document (and of all, last)."""
    n = len(data)
    inner = np.zeros(n + 2, bool)
    inner[1 : n + 1] = ~blank[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inner[1 : n + 1] & (~inner[:n] | edge[:n]))
    ends = np.flatnonzero(inner[1 : n + 1] & (~inner[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def portions(column: pa.Array, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts of a column of about ``most`` bytes each."""
    _, offsets = raw(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, min(high, len(column)) - low
        low = high


def word_hashes(column: pa.Array, lower: bool = False, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a batch of UTF-8 texts, and where each document's words begin (and all end).

    A word is read in parts of eight bytes. Each part is mixed with its number in the word before the parts are summed,
    so words of up to eight bytes and one length never hash alike. Longer words can be made so that they do: this hash
    serves features, where that only costs accuracy; ``keyed_hashes`` serves comparisons.
    """
    data, offsets = raw(column)
    starts, ends, first = spans(data, offsets, blank)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    total = mix((eight[starts] & _MASK[np.minimum(size, 8)]) + _U(0xD1342543DE82EF95))
    more = np.flatnonzero(size > 8)
    if len(more):
        count = size[more] - 1 >> 3
        head = np.cumsum(count) - count
        nth = np.arange(int(count.sum())) - np.repeat(head, count) + 1
        at, left = np.repeat(starts[more], count) + 8 * nth, np.repeat(size[more], count) - 8 * nth
        part = mix((eight[at] & _MASK[np.minimum(left, 8)]) + _U(0x2545F4914F6CDD1D))
        total[more] += np.add.reduceat(mix(part + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), head)
    return mix(total + size.astype(np.uint64) * _U(0xA0761D6478BD642F)), first


def keyed_hashes(column: pa.Array, seeds: Sequence[int], lower: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """A 64-bit hash of each word of a batch for each seed, and where each document's words begin (and all end).

    Each part of eight bytes is mixed with a key of its place, twice, and the two results are multiplied, so that a part
    does not follow from its term. Seeds come from a digest of the whole input (``corpus_seeds``): who changes a word
    to meet another one's hash changes the keys.
    """
    data, offsets = raw(column)
    starts, ends, first = spans(data, offsets)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    head_part = eight[starts] & _MASK[np.minimum(size, 8)]
    more = np.flatnonzero(size > 8)
    if len(more):
        count = size[more] - 1 >> 3
        head = np.cumsum(count) - count
        nth = np.arange(int(count.sum())) - np.repeat(head, count) + 1
        at, left = np.repeat(starts[more], count) + 8 * nth, np.repeat(size[more], count) - 8 * nth
        parts, nth = eight[at] & _MASK[np.minimum(left, 8)], nth.astype(np.uint64)

    def terms(part: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
        key = mix(_U(seed) + place * _U(0x9E3779B97F4A7C15))
        return mix(part ^ key) * (mix(part + mix(key + _U(0xD1342543DE82EF95))) | _U(1))

    out = []
    for seed in seeds:
        total = terms(head_part, np.zeros(1, np.uint64), seed)
        if len(more):
            total[more] += np.add.reduceat(terms(parts, nth, seed), head)
        out.append(mix(total + size.astype(np.uint64) * _U(0xA0761D6478BD642F)))
    return out, first


def lowered(text: bytes) -> list[bytes]:
    """The words of a text with A-Z in lower case."""
    return text.translate(_LOWER.tobytes()).split()


def exact_shingles(text: bytes, n: int) -> set[bytes]:
    """The shingles of ``n`` lower-cased words themselves; words hold no blank, so a joined shingle is told by its bytes."""
    words = lowered(text)
    return {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {b" ".join(words)} if words else set()


def window_hashes(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """The hash of the ``n`` words from each place on, for the places that have so many after them in ``words``.

    Windows of 2, 4, 8, ... words are made of two halves, each time mixed, and put together to ``n`` words.
    """
    count = len(words) - n + 1
    if count <= 0 or n <= 0:
        return np.zeros(0, np.uint64)
    factor = _U((2 * seed + 1) * 0xE7037ED1A0B428DB & (1 << 64) - 1 | 1)
    out, done, width, level = None, 0, 1, words
    while True:
        if n & width:
            part = level[done : done + count]
            out = part if out is None else mix(out * factor + part)
            done += width
        if 2 * width > n:
            return mix(out * factor + _U(n))
        level = mix(level[:-width] * factor + level[width:])
        width *= 2


def shingle_sets(column: pa.Array, n: int, seed: int = 0, bits: int = 64) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each document's shingles of ``n`` lower-cased words; fewer words are one shingle."""
    (words,), first = keyed_hashes(column, [seed], lower=True)
    short = (lambda x: x) if bits == 64 else lambda x: mix(x >> _U(64 - bits))
    every = short(window_hashes(words, n))
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        else:
            yield short(window_hashes(words[a:b], int(b - a))) if b > a else np.zeros(0, np.uint64)
