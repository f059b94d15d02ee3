"""A keyed permutation of the numbers below ``n``: a shuffle whose positions are computed, not sorted.

The numbers are laid out in a rectangle of ``ceil(sqrt(n))`` columns and just
enough rows. Each round adds a mix of one coordinate to the other, modulo its
range (an alternating Feistel network), which can be undone step by step. A
number that falls into the few cells beyond ``n`` is sent through again until
it is below ``n``; these walks are the network's own cycles, so the whole is
one-to-one again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

ROUNDS = 6
WALK = 64  # fewer than 64 cells lie beyond an n of up to 4,096; beyond that such a walk has a chance below n^-32

# Fixed values: (x + key) * FACTORS[0] and then * FACTORS[1], each time the middle 32 bits of the product.
FACTORS, MIDDLE, LOW = (0x45D9F3B1, 0x2545F491), 16, (1 << 32) - 1

def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) for i in range(rounds)]


def _mix(value: Column) -> Column:
    for factor in FACTORS:
        value = F.shiftright(value.bitwiseAND(LOW) * factor, MIDDLE)
    return value.bitwiseAND(LOW)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _pass(x: Column, columns: Column, rows: Column, keys: Sequence[Column], back: bool) -> Column:
    """The rounds over the number ``x``, as one arithmetic expression: each replaces one coordinate, in turn."""
    place, ranges = [x % columns, _div(x, columns)], (columns, rows)
    turns = list(enumerate(keys))
    for i, key in reversed(turns) if back else turns:
        own, other = i % 2, 1 - i % 2
        shift = _mix(place[other] + key)
        place[own] = F.pmod(place[own] - shift, ranges[own]) if back else (place[own] + shift) % ranges[own]
    return place[0] + place[1] * columns


def _permuted(index: Column, n: Column | int, seed: int, salt: Column | None, back: bool) -> Column:
    keys = [F.lit(k).cast("long") for k in round_keys(seed)]
    if salt is not None:
        keys = [k + _mix(salt.cast("long") + i) for i, k in enumerate(keys)]
    index, n = index.cast("long"), (F.lit(n) if isinstance(n, int) else n).cast("long")
    columns = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("long")
    rows = _div(n + columns - 1, columns)
    once = _pass(index, columns, rows, keys, back)
    again = lambda y, _: F.when(y < n, y).otherwise(_pass(y, columns, rows, keys, back))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, again)
    outside = F.concat(F.lit("no place for number "), F.coalesce(index.cast("string"), F.lit("null")))
    inside = (index >= 0) & (index < n)
    return F.when(inside & (once < n), once).when(inside, walk).otherwise(F.raise_error(outside).cast("long"))


def permuted(index: Column, n: Column | int, seed: int, salt: Column | None = None) -> Column:
    """The place of number ``index`` among 0 .. ``n`` - 1 after the shuffle of this seed (and salt).

    Every number has one place and every place one number, for each ``n``. A
    number outside the range, or a null, fails the job.
    """
    return _permuted(index, n, seed, salt, back=False)


def unpermuted(place: Column, n: Column | int, seed: int, salt: Column | None = None) -> Column:
    """The number that :func:`permuted` puts at ``place``."""
    return _permuted(place, n, seed, salt, back=True)
