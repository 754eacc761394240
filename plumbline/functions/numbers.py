"""Numbers as other systems round them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_even(x: Column, digits: int) -> Column:
    """A double rounded to decimal digits by its exact binary value, halves to even.

    Spark's bround sees the shortest decimal that stands for a double, so what
    is just under a half for it may be over. Here |x| is written as m / 2^s with
    whole m, and m * 10^digits is divided by 2^s in whole decimals. From 2^52 on
    doubles are whole and stay; null, NaN and the infinities stay as well.
    """
    if not 0 <= digits <= 15:
        raise ValueError("digits must lie between 0 and 15")
    whole = "decimal(38,0)"
    size = F.abs(x)
    tiny = size * 10.0**digits < 0.25
    s = F.greatest(F.lit(0), 52 - F.floor(F.log2(size)).cast("int"))
    m = (size * F.pow(F.lit(2.0), s)).cast("long").cast(whole)
    low = F.least(s, F.lit(62))
    power = lambda k: F.expr("1L").cast("long") if k is None else F.call_function("shiftleft", F.lit(1).cast("long"), k).cast(whole)
    unit = (power(low) * power(s - low)).cast(whole)
    scaled = (m * F.lit(10**digits).cast(whole)).cast(whole)
    rest = (scaled % unit).cast(whole)
    quotient = ((scaled - rest) / unit).cast(whole)
    twice = (rest * F.lit(2).cast(whole)).cast(whole)
    up = (twice > unit) | ((twice == unit) & (quotient % 2 != 0))
    rounded = F.concat((quotient + F.when(up, 1).otherwise(0)).cast(whole).cast("string"), F.lit(f"E-{digits}")).cast("double")
    plain = x.isNull() | F.isnan(x) | (size >= 2.0**52)
    return F.when(plain, x).when(tiny, x * 0.0).otherwise(F.when(x < 0, -rounded).otherwise(rounded))
