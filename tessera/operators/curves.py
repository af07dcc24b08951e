"""Numbers along a Hilbert curve in two and three dimensions, as columns.

The published bitwise method (Skilling 2004) works on one bit of all coordinates at a time. What it does to the lower
bits is an order of the axes and an inversion of some: a state, of which there are few. So several bits go at a step, by
a table of state and bits that is made once. The steps are plain expressions, each used by the next and by the result,
which Spark compiles and computes once a row; there are at most 8 in two dimensions and 11 in three.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = "xyz"
#: Bits of a coordinate that go at a step, by the number of axes.
WIDTHS = {2: 4, 3: 2}


def _long(value: int | Column) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("long")


def _checked(n: int, bits: int) -> None:
    if n not in (2, 3) or not 1 <= bits <= 63 // n:
        raise ValueError("two or three coordinates of up to 31 or 21 bits")


def _level(state: tuple, given: Sequence[int]) -> tuple[tuple, tuple]:
    """The curve's digit, bit by bit, of one bit of each coordinate, and the state of the bits below.

    A state is the axis and the inversion that each place takes, and whether the Gray code is inverted.
    """
    places, odd = list(state[0]), state[1]
    x = [given[axis] ^ turned for axis, turned in places]
    for i, hit in enumerate(x):
        if hit:
            places[0] = (places[0][0], places[0][1] ^ 1)
        else:
            places[0], places[i] = places[i], places[0]
    gray = [sum(x[: i + 1]) % 2 for i in range(len(x))]
    return tuple(g ^ odd for g in gray), (tuple(places), odd ^ gray[-1])


@cache
def _levels(n: int) -> tuple[list, list]:
    """For each state: digit and following state by the coordinates' bits; and the states after 0, 1.. levels of zeros."""
    states, known = [(tuple((i, 0) for i in range(n)), 0)], []
    for state in states:
        known.append({})
        for given in product((0, 1), repeat=n):
            digit, after = _level(state, given)
            if after not in states:
                states.append(after)
            known[-1][given] = (digit, states.index(after))
    zeros = [0]
    while (after := known[zeros[-1]][(0,) * n][1]) != 0:
        zeros.append(after)
    return known, zeros


def _bundled(levels: Sequence[Sequence[int]], form: str) -> int:
    """Bits of some levels as one number: axis after axis, or level after level, for Morton numbers from the last axis on."""
    bits = zip(*levels, strict=True) if form == "axes" else [level[::-1] for level in levels] if form == "morton" else levels
    return int("".join(str(b) for part in bits for b in part), 2)


@cache
def _table(n: int, source: str, target: str) -> str:
    """By state and bits of a step in the form ``source``: the bits in the form ``target``, and above them the next state."""
    known, _ = _levels(n)
    width = WIDTHS[n]
    size = 1 << n * width
    out = [0] * (len(known) * size)
    for first in range(len(known)):
        for levels in product(product((0, 1), repeat=n), repeat=width):
            digits, state = [], first
            for given in levels:
                digit, state = known[state][given]
                digits.append(digit)
            forms = {f: _bundled(digits if f == "hilbert" else levels, f) for f in (source, target)}
            out[first * size + forms[source]] = state * size + forms[target]
    return ",".join(map(str, out))


def _walked(values: Sequence[Column], n: int, bits: int, source: str, target: str) -> Column:
    """Coordinates (``axes``) or one number in the form ``source``, in the form ``target``; of larger ones the low bits count."""
    _checked(n, bits)
    width = WIDTHS[n]
    steps, size = -(-bits // width), 1 << n * width
    zeros = _levels(n)[1]
    entry = F.lit(zeros[(bits - steps * width) % len(zeros)] * size)  # levels of zeros above the highest bit lead to the first state
    table = F.split(F.lit(_table(n, source, target)), ",").cast("array<int>")

    def parts(form: str) -> list[tuple[str, int, int]]:
        """Name, bits a level and place in a step's bits of each number of a form."""
        return [(a, 1, width * (n - 1 - i)) for i, a in enumerate(AXES[:n])] if form == "axes" else [("x", n, 0)]

    out = [_long(0) for _ in parts(target)]
    for k in range(steps - 1, -1, -1):
        here = entry.bitwiseAND(F.lit(-size))
        for v, (_, w, at) in zip(values, parts(source), strict=True):
            given = F.shiftright(_long(v), k * width * w).bitwiseAND(_long((1 << min(width, bits - k * width) * w) - 1))
            here = here.bitwiseOR(F.shiftleft(given.cast("int"), at))
        entry = table[here]
        for i, (_, w, at) in enumerate(parts(target)):
            found = F.shiftright(entry, at).bitwiseAND(F.lit((1 << width * w) - 1)).cast("long")
            out[i] = out[i].bitwiseOR(F.shiftleft(found, k * width * w))
    return F.struct(*[v.alias(a) for v, (a, _, _) in zip(out, parts(target), strict=True)]) if target == "axes" else out[0]


def _one(code: Column | str) -> list[Column]:
    return [F.col(code) if isinstance(code, str) else code]


def hilbert(coords: Sequence[Column | str], bits: int) -> Column:
    """The number along the curve of two or three non-negative coordinates of ``bits`` bits."""
    return _walked([F.col(c) if isinstance(c, str) else c for c in coords], len(coords), bits, "axes", "hilbert")


def unhilbert(code: Column | str, n: int, bits: int) -> Column:
    """The coordinates x, y (and z) of a number along the curve, as a struct."""
    return _walked(_one(code), n, bits, "hilbert", "axes")


def morton2hilbert(code: Column | str, n: int, bits: int) -> Column:
    """The number along the curve of a Morton number, whose lowest bit is the first coordinate's."""
    return _walked(_one(code), n, bits, "morton", "hilbert")


def hilbert2morton(code: Column | str, n: int, bits: int) -> Column:
    return _walked(_one(code), n, bits, "hilbert", "morton")


def nest2peano(pix: Column | str, nside: int) -> Column:
    """The number of a NEST pixel along a curve through its face; faces follow each other as they are numbered."""
    order, value = nside.bit_length() - 1, _long(F.col(pix) if isinstance(pix, str) else pix)
    if nside < 1 or nside & (nside - 1):
        raise ValueError("nside must be a power of two")
    inner = nside * nside
    return value if order == 0 else F.floor(value / inner).cast("long") * inner + morton2hilbert(F.pmod(value, F.lit(inner)), 2, order)


def peano2nest(code: Column | str, nside: int) -> Column:
    order, value = nside.bit_length() - 1, _long(F.col(code) if isinstance(code, str) else code)
    if nside < 1 or nside & (nside - 1):
        raise ValueError("nside must be a power of two")
    inner = nside * nside
    return value if order == 0 else F.floor(value / inner).cast("long") * inner + hilbert2morton(F.pmod(value, F.lit(inner)), 2, order)
