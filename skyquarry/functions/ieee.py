"""Floating-point semantics of array engines as Columns: division never raises, and results are cleaned of NaN and infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands for missing pixels in exported rasters.
NODATA = -9999.0


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is infinite with x's sign, 0/0 is NaN; null if either side is null."""
    zero = (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when((a == 0) | F.isnan(a), F.lit(float("nan")))
        .when(a > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(b != 0, F.try_divide(a, b)).otherwise(zero)


def clean(v: Column) -> Column:
    """NaN becomes 0 first; then what is beyond 1e30 in size becomes nodata."""
    return F.when(F.isnan(v), F.lit(0.0)).when(F.abs(v) > 1e30, F.lit(NODATA)).otherwise(v)


def half_away(v: Column, digits: int = 6) -> Column:
    """Rounded in binary: times a power of ten, to the nearest integer (halves away from zero), divided again; zero keeps its sign.

    Spark's own round takes the decimal digits that a double is shown with, so 128.605,
    which is a little less in binary, becomes 128.61 there and 128.6 here.
    """
    v, power = v.cast("double"), 10.0**digits
    out = F.round(v * power) / power
    return F.when(out == 0, F.signum(v) * 0.0).otherwise(out)


def rounded(v: Column, digits: int = 6) -> Column:
    """Rounded in binary, and never negative zero."""
    return half_away(v, digits) + F.lit(0.0)
