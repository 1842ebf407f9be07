"""Rounding of doubles by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits.
_SPLIT = float((1 << 27) + 1)


def _halves(x: Column) -> tuple[Column, Column]:
    high = x * _SPLIT - (x * _SPLIT - x)
    return high, x - high


def round_binary(x: Column, digits: int) -> Column:
    """x to so many decimals, by the exact value that the double holds, halves to even: 2.675 is a little
    below the half and goes to 2.67.

    The product x * 10**digits is taken together with its rounding error (Dekker's product), so a value
    that only looks like a half is told from one that is. Values of 2**52 and more at that scale, NaN and
    infinities are themselves; null is null.
    """
    scale = float(10**digits)
    x = x.cast("double")
    p = x * scale
    (a, b), (c, d) = _halves(x), _halves(F.lit(scale))
    error = ((a * c - p) + a * d + b * c) + b * d
    low = F.floor(p).cast("double")
    at_half = p - low == 0.5
    whole = F.when(at_half & (error > 0), low + 1).when(at_half & (error < 0), low).otherwise(F.rint(p))
    return F.when(F.abs(p) < float(1 << 52), whole / scale).otherwise(x)
