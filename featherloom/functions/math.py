"""Null-aware arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _d(c: Column) -> Column:
    return c.cast("double")


def add(a: Column, b: Column) -> Column:
    """A missing side counts as nothing; both missing give null."""
    return F.coalesce(_d(a) + _d(b), _d(a), _d(b))


def subtract(a: Column, b: Column) -> Column:
    return F.coalesce(_d(a) - _d(b), _d(a), -_d(b))


def multiply(a: Column, b: Column) -> Column:
    return finite(_d(a) * _d(b))


def divide(a: Column, b: Column) -> Column:
    return finite(F.try_divide(_d(a), _d(b)))


def add_scalar(c: Column, k: float) -> Column:
    return _d(c) + F.lit(float(k))


def subtract_scalar(c: Column, k: float) -> Column:
    return _d(c) - F.lit(float(k))


def multiply_scalar(c: Column, k: float) -> Column:
    return finite(_d(c) * F.lit(float(k)))


def divide_scalar(c: Column, k: float) -> Column:
    return finite(F.try_divide(_d(c), F.lit(float(k))))


def absolute(c: Column) -> Column:
    return F.abs(_d(c))


def ceil(c: Column) -> Column:
    return F.ceil(_d(c)).cast("long")


def floor(c: Column) -> Column:
    return F.floor(_d(c)).cast("long")


def round_half_up(c: Column) -> Column:
    return F.floor(_d(c) + 0.5).cast("long")


def round_digits(c: Column, digits: int) -> Column:
    k = float(10**digits)
    return finite(F.floor(_d(c) * k + 0.5) / k)


def exp(c: Column) -> Column:
    return finite(F.exp(_d(c)))


def sqrt(c: Column) -> Column:
    return finite(F.sqrt(_d(c)))


def log(c: Column, base: float) -> Column:
    if base <= 0:
        raise ValueError("the base of a logarithm is positive")
    return finite(F.log10(_d(c)) / F.log10(F.lit(float(base))))


def power(c: Column, p: float) -> Column:
    return finite(F.pow(_d(c), F.lit(float(p))))


def scale_linear(c: Column, slope: float, intercept: float) -> Column:
    if slope == 0:
        raise ValueError("a slope of 0 cannot be undone")
    return _d(c) * slope + intercept


def descale_linear(c: Column, slope: float, intercept: float) -> Column:
    return (_d(c) - intercept) / slope


def scale_log(c: Column) -> Column:
    return finite(F.ln(_d(c)))


def descale_log(c: Column) -> Column:
    return finite(F.exp(_d(c)))


def bucket_index(c: Column, splits: list[float], left_inclusive: bool = True) -> Column:
    """Number of the bucket of c between sorted splits; null outside of them and for null."""
    if len(splits) < 3 or any(a >= b for a, b in zip(splits, splits[1:], strict=False)):
        raise ValueError("at least three strictly increasing splits")
    x = _d(c)
    out = F.lit(None).cast("int")
    last = len(splits) - 2
    for i in range(last, -1, -1):
        lo, hi = splits[i], splits[i + 1]
        if left_inclusive:
            inside = (x >= lo) & ((x <= hi) if i == last else (x < hi))
        else:
            inside = ((x >= lo) if i == 0 else (x > lo)) & (x <= hi)
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def bucketize(c: Column, splits: list[float], left_inclusive: bool = True, track_nulls: bool = True, track_invalid: bool = True) -> Column:
    """One-hot vector of the bucket, then slots for values outside of all buckets and for nulls."""
    i = bucket_index(c, splits, left_inclusive)
    slots = [F.when(i == k, 1.0).otherwise(0.0) for k in range(len(splits) - 1)]
    if track_invalid:
        slots.append(F.when(c.isNotNull() & i.isNull(), 1.0).otherwise(0.0))
    if track_nulls:
        slots.append(F.when(c.isNull(), 1.0).otherwise(0.0))
    return F.array(*slots)
