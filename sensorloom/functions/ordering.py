"""Whole numbers that sort as values do, and the bits of doubles, by plain arithmetic."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Above the key of infinity.
NAN_KEY = (1 << 63) - 1
LEAST_NORMAL = 2.0**-1022


def magnitude_bits(x: Column) -> Column:
    """The bits of |x|'s IEEE 754 form as a long, for finite doubles and infinities: exponent, then mantissa.

    The exponent comes from a logarithm and is put right by comparing; scaling by powers of two is exact.
    """
    a = F.abs(x)
    power = lambda e: F.pow(F.lit(2.0), e)
    guess = F.greatest(F.least(F.floor(F.log2(a)), F.lit(1023)), F.lit(-1022))
    low = guess - (a < power(guess)).cast("long")
    ratio = a / power(low)  # in [1, 4)
    above = (ratio >= 2).cast("long")
    scaled = F.when(above == 1, ratio / 2).otherwise(ratio)
    normal = (low + above + 1023) * (1 << 52) + ((scaled - 1.0) * float(1 << 52)).cast("long")
    tiny = (a * 2.0**537 * 2.0**537).cast("long")
    return F.when(a == float("inf"), F.lit(2047 << 52)).when(a < LEAST_NORMAL, tiny).otherwise(normal)


def order_key(value: Column, scale: int | None) -> Column:
    """A long that sorts as the value does. scale: decimals of a DECIMAL(18, scale); None: a double, with NaN above infinity.

    Both zeros have the same key.
    """
    if scale is not None:
        return (value * F.lit(Decimal(10) ** scale)).cast("decimal(18,0)").cast("long")
    bits = magnitude_bits(value)
    return F.when(F.isnan(value), F.lit(NAN_KEY)).when(value < 0, -bits).otherwise(bits)
