"""The 32-bit mix hash (F2) and draws made of it, as columns and as numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the mix.
MULTIPLIER = 0x45D9F3B
MASK = 0xFFFFFFFF


def mix(x: Column) -> Column:
    """Unsigned 32-bit hash of the low 32 bits of a long, as a long."""
    x = x.cast("long").bitwiseAND(MASK)
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(MULTIPLIER).cast("long")).bitwiseAND(MASK)
    return F.shiftright(x, 16).bitwiseXOR(x)


def as_signed(x: Column) -> Column:
    """The same 32 bits read as a signed number."""
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)


def mix_np(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x).astype(np.uint64) & np.uint64(MASK)
    for _ in range(2):
        x = (((x >> np.uint64(16)) ^ x) * np.uint64(MULTIPLIER)) & np.uint64(MASK)
    return ((x >> np.uint64(16)) ^ x).astype(np.int64)


def bound(x: Column, use) -> Column:
    """use(x) with x computed once, however often use names it."""
    return F.get(F.transform(F.array(x), use), 0)


def draw(seed: int, *parts: Column) -> Column:
    """A seeded 32-bit draw for each element: the same in any partition and in any order."""
    x = F.lit(int(mix_np(np.array(seed & MASK)))).cast("long")
    for p in parts:
        x = bound(x.bitwiseXOR(bound(p.cast("long") + 1, mix)), mix)
    return x


def draw_np(seed: int, *parts) -> np.ndarray:
    x = mix_np(np.array(seed & MASK))
    for p in parts:
        x = mix_np(x ^ mix_np(np.asarray(p) + 1))
    return x
