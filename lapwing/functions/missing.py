"""Numbers that may be missing: NULL or NaN in samples, and arithmetic that never raises.

Missing is stored as NULL; arithmetic on doubles may give NaN or an infinity and is made NULL again
before aggregation. The functions below keep IEEE results where Spark would raise or give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def finite(v: Column) -> Column:
    """Is it a number, neither NULL nor NaN nor infinite?"""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(INF))


def present(v: Column) -> Column:
    """The value where it is finite, else NULL."""
    return F.when(finite(v), v)


def divide(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN at zero."""
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))
    return F.when(b == 0, at_zero).otherwise(a / F.when(b != 0, b))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; NaN for divisor 0."""
    d = F.when(b != 0, b)
    return F.when(b == 0, F.lit(NAN)).otherwise(a - F.floor(a / d).cast("double") * d)


def log_or_nan(v: Column, base10: bool = False) -> Column:
    """Logarithm; -inf at 0, NaN below."""
    f = F.log10 if base10 else F.ln
    return F.when(v < 0, F.lit(NAN)).when(v == 0, F.lit(-INF)).otherwise(f(v))


def pairwise(a: Column, b: Column, smaller: bool) -> Column:
    """The smaller or larger of two; NaN if either is."""
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise((F.least if smaller else F.greatest)(a, b))


def truth(v: Column) -> Column:
    """Non-zero is true, and so is NaN."""
    return F.isnan(v) | (v != 0)


def flag(condition: Column) -> Column:
    """1.0 or 0.0."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def compare(a: Column, b: Column, how: str) -> Column:
    """IEEE comparison as 1.0 or 0.0: with NaN only `!=` holds."""
    nan = F.isnan(a) | F.isnan(b)
    tests = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
    return flag((nan | tests[how]) if how == "!=" else (~nan & tests[how]))


def rounded(v: Column, digits: int = 5) -> Column:
    """Half up by floor, and a little early, so that engines agree on ties that come out a bit above or below."""
    k = float(10**digits)
    return F.floor(v * k + 0.5001).cast("double") / k
