"""Numeric column expressions with the rounding rules that results depend on."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def let(value, body) -> Column:
    """body(value) with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(col(value)), body)[0]


def round_half_up(x, digits: int = 0) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits: ties go towards plus infinity."""
    p = 10.0**digits
    return F.floor(col(x) * F.lit(p) + F.lit(0.5)) / F.lit(p)


def round_bankers(x, digits: int = 0) -> Column:
    """Ties go to the even neighbour."""
    return F.bround(col(x), digits)


def one_decimal(x) -> Column:
    """The text of a number with one decimal as C prints it: by its exact binary value, ties to even (``format_string`` rounds the shortest text half up).

    Ten times x is 8 x + 2 x, both exact, and what their sum loses is known; below 2**49.
    """
    v = F.abs(col(x))
    a, b = v * 8.0, v * 2.0
    s = a + b
    lost = (a - (s - (s - a))) + (b - (s - a))
    n = F.floor(s)
    half = s - n - 0.5
    up = (half > 0) | ((half == 0) & ((lost > 0) | ((lost == 0) & (n % 2 == 1))))
    tenths = n + up.cast("long")
    sign = F.when(col(x) < 0, "-").otherwise("")
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def clamp(x, low, high) -> Column:
    """Null stays null."""
    v = col(x)
    return F.when(v.isNull(), None).when(v < low, F.lit(low)).when(v > high, F.lit(high)).otherwise(v)


def share(part, whole, digits: int = 4) -> Column:
    """part / whole rounded, null where whole is 0."""
    return F.when(col(whole) > 0, round_half_up(col(part) / col(whole), digits))


def wilson(hits, n, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson score interval (low, high) of hits out of n; null where n is 0."""
    h, m = col(hits).cast("double"), F.nullif(col(n).cast("double"), F.lit(0.0))
    p, zz = h / m, z * z
    mid = p + zz / (2 * m)
    half = F.lit(z) * F.sqrt(p * (1 - p) / m + zz / (4 * m * m))
    low = F.greatest((mid - half) / (1 + zz / m), F.lit(0.0))
    high = F.least((mid + half) / (1 + zz / m), F.lit(1.0))
    return F.when(m > 0, low), F.when(m > 0, high)


#: The five-term polynomial of Abramowitz and Stegun 7.1.26.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def erf(x) -> Column:
    def of(v: Column) -> Column:
        a = F.abs(v)

        def tail(t: Column) -> Column:
            poly = F.lit(ERF[4])
            for c in ERF[3::-1]:
                poly = poly * t + F.lit(c)
            return 1.0 - poly * t * F.exp(-a * a)

        y = let(1.0 / (1.0 + F.lit(ERF_P) * a), tail)
        return y * F.when(v < 0, -1.0).otherwise(1.0)

    return let(x, of)


def normal_cdf(x) -> Column:
    return 0.5 * (1.0 + erf(col(x) / F.lit(math.sqrt(2))))


def split_normal_cdf(x, mode, sd_low, sd_high) -> Column:
    """The distribution function of a normal with one spread below its mode and another above."""
    v, m, a, b = col(x), col(mode), col(sd_low), col(sd_high)
    whole = a + b
    below = (2.0 * a / whole) * normal_cdf((v - m) / a)
    above = a / whole + (b / whole) * (2.0 * normal_cdf((v - m) / b) - 1.0)
    return F.when(v <= m, below).otherwise(above)
