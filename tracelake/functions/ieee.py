"""Double arithmetic as IEEE 754 and array libraries have it, on columns.

Spark raises or gives NULL for a division by zero and logarithms out of their domain, takes NaN for equal to NaN and larger than all numbers, and
has integers come out of floor and ceil. These functions give infinities, NaN and doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: Doubles from here on are whole numbers.
WHOLE = float(1 << 53)


def _ok(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


def divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(a * F.pow(b, F.lit(-1.0)))


def equal(a: Column, b: Column) -> Column:
    return _ok(a, b) & (a == b)


def compare(op: str, a: Column, b: Column) -> Column:
    return _ok(a, b) & {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _log(function, x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(NAN)).when(x > 0, function(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def ln(x: Column) -> Column:
    return _log(F.ln, x)


def log10(x: Column) -> Column:
    return _log(F.log10, x)


def log2(x: Column) -> Column:
    return _log(F.log2, x)


def _rounded(function, x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE), x).otherwise(function(x).cast("double"))


def floor(x: Column) -> Column:
    return _rounded(F.floor, x)


def ceil(x: Column) -> Column:
    return _rounded(F.ceil, x)


def truncate(x: Column) -> Column:
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def least(*xs: Column) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = F.when(F.isnan(out) | F.isnan(x), F.lit(NAN)).otherwise(F.least(out, x))
    return out


def greatest(*xs: Column) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = F.when(F.isnan(out) | F.isnan(x), F.lit(NAN)).otherwise(F.greatest(out, x))
    return out


def _minus_zero(x: Column) -> Column:
    return (x == 0) & (F.pow(x, F.lit(-1.0)) < 0)


def atan2(y: Column, x: Column) -> Column:
    """With the signs of zeros, which Spark's function drops."""
    back = (x < 0) | _minus_zero(x)
    return F.when((y == 0) & ~F.isnan(x), F.when(back, F.when(_minus_zero(y), F.lit(-math.pi)).otherwise(F.lit(math.pi))).otherwise(F.lit(0.0))).otherwise(F.atan2(y, x))


def ramp(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(NAN)).otherwise(F.greatest(x, F.lit(0.0)))


def number(condition: Column) -> Column:
    return condition.cast("double")
