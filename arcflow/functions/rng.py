"""Stateless uniform numbers: the same key gives the same bits in Spark, in NumPy and in SQL.

A key is whole numbers. Each is taken as two words of 32 bits, and each word is mixed into
32 bits by xors, shifts and two multiplications whose factors are below 2^31, so that no
product exceeds a signed 64-bit integer and engines that check overflow agree with those
that wrap.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# A published mixer of 32 bits, and what sets its start and the second word apart.
FACTORS = (0x21F0AAAD, 0x735A2D97)
SHIFTS = (16, 15, 15)
START, SECOND = 0x2545F491, 0x5851F42D
_MASK = 0xFFFFFFFF


def _step(shift: int, factor: int | None) -> Callable[[Column], Column]:
    def run(x: Column) -> Column:
        x = x.bitwiseXOR(F.shiftright(x, shift))
        return x if factor is None else (x * F.lit(factor).cast("long")).bitwiseAND(F.lit(_MASK))

    return run


def _mix_column(x: Column) -> Column:
    """Each step names the last one's value once, as a column that names it twice would double in size with each."""
    for shift, factor in zip(SHIFTS, (*FACTORS, None), strict=True):
        x = F.transform(F.array(x), _step(shift, factor))[0]
    return x


def uniform(*key: Column | int) -> Column:
    """A number in [0, 1) with 52 bits for a key of whole numbers, each below 2^63 and not below -2^63."""
    h = F.lit(START).cast("long")
    for part in key:
        part = part.cast("long") if isinstance(part, Column) else F.lit(part).cast("long")
        for word in (part.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(part, 32)):
            h = _mix_column(h.bitwiseXOR(word))
    both = F.transform(F.array(h), lambda h: h.cast("double") * float(1 << 20) + F.shiftright(_mix_column(h.bitwiseXOR(F.lit(SECOND))), 12).cast("double"))
    return both[0] / F.lit(float(1 << 52))


def _mix_array(x: np.ndarray) -> np.ndarray:
    for shift, factor in zip(SHIFTS, (*FACTORS, None), strict=True):
        x = x ^ (x >> np.uint64(shift))
        if factor is not None:
            x = (x * np.uint64(factor)) & np.uint64(_MASK)
    return x


def uniform_array(*key: np.ndarray | int) -> np.ndarray:
    """`uniform` of arrays."""
    h = np.uint64(START)
    for part in key:
        part = np.asarray(part, np.int64).view(np.uint64)
        for word in (part & np.uint64(_MASK), part >> np.uint64(32)):
            h = _mix_array(h ^ word)
    low = _mix_array(h ^ np.uint64(SECOND))
    return (h.astype(np.float64) * float(1 << 20) + (low >> np.uint64(12)).astype(np.float64)) / float(1 << 52)


def _sql_mix(x: str) -> str:
    """The mixer of an SQL expression, by lists of one element, so that each step names the last one's value once."""
    first, second = FACTORS
    steps = (f"xor(x, x >> {SHIFTS[0]}) * {first} & {_MASK}", f"xor(x, x >> {SHIFTS[1]}) * {second} & {_MASK}", f"xor(x, x >> {SHIFTS[2]})")
    for step in steps:
        x = f"list_transform([{x}], lambda x: {step})[1]"
    return x


def uniform_sql(*key: str | int) -> str:
    """`uniform` in SQL of integer expressions that aren't negative."""
    h = str(START)
    for part in key:
        for word in (f"(({part})::bigint & {_MASK})", f"(({part})::bigint >> 32)"):
            h = _sql_mix(f"xor(({h})::bigint, {word})")
    return f"list_transform([{h}], lambda x: (x::double * {1 << 20} + ({_sql_mix(f'xor(x, {SECOND}::bigint)')} >> 12)::double) / {float(1 << 52)})[1]"
