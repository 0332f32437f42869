"""A counter-based 32-bit generator: number k of a seed depends on (seed, k) only, so draws need no order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import let

_MASK = 0xFFFFFFFF
#: The generator's increment, and FNV-1a's offset and prime.
STEP, FNV_OFFSET, FNV_PRIME = 0x6D2B79F5, 0x811C9DC5, 0x01000193


def seed_from(text: str) -> int:
    """FNV-1a over UTF-16 code units."""
    h = FNV_OFFSET
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * FNV_PRIME) & _MASK
    return h


def _mul(a: Column, b: Column) -> Column:
    """a * b modulo 2**32 for values below 2**32, without overflow: by halves of b."""
    upper = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(_MASK)), 16)
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + upper).bitwiseAND(F.lit(_MASK))


def uniform(seed: int, k: Column) -> Column:
    """Output k (from 0) of the generator, in [0, 1)."""
    m = F.lit(_MASK)
    state = (F.lit(seed) + _mul(F.lit(STEP).cast("long"), (k + 1).cast("long").bitwiseAND(m))).bitwiseAND(m)

    def stir(t: Column) -> Column:
        return (t + _mul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(m).bitwiseXOR(t)

    first = let(state, lambda a: _mul(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("long"))))
    return let(let(first, stir), lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0))


def normal(seed: int, k: Column) -> Column:
    """A standard normal from outputs k and k + 1 (Box-Muller)."""
    u1, u2 = F.greatest(F.lit(1e-12), uniform(seed, k)), uniform(seed, k + 1)
    return F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def python_uniforms(seed: int, n: int) -> list[float]:
    """The same numbers in sequence, for tests."""
    out, a = [], seed & _MASK
    for _ in range(n):
        a = (a + STEP) & _MASK
        t = ((a ^ a >> 15) * (a | 1)) & _MASK
        t = ((t + ((t ^ t >> 7) * (t | 61))) & _MASK) ^ t
        out.append((t ^ t >> 14) / 4294967296)
    return out

