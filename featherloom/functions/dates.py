"""Date columns: epoch milliseconds, UTC. Weeks begin on Monday and the first week of a year may have one day."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

DAY_MS = 86_400_000
#: period: (least, greatest value)
PERIODS = {"DayOfMonth": (1, 31), "DayOfWeek": (1, 7), "DayOfYear": (1, 366), "HourOfDay": (0, 24), "MonthOfYear": (1, 12), "WeekOfMonth": (1, 6), "WeekOfYear": (1, 53)}


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def time_period(ms: Column, period: str) -> Column:
    t = F.timestamp_millis(ms)
    d = t.cast("date")
    if period == "DayOfMonth":
        return F.dayofmonth(d)
    if period == "DayOfWeek":
        return F.weekday(d) + 1
    if period == "DayOfYear":
        return F.dayofyear(d)
    if period == "HourOfDay":
        return F.hour(t)
    if period == "MonthOfYear":
        return F.month(d)
    if period == "WeekOfMonth":
        return (F.floor((F.dayofmonth(d) - 1 + F.weekday(F.trunc(d, "month"))) / 7) + 1).cast("int")
    if period == "WeekOfYear":
        return (F.floor((F.dayofyear(d) - 1 + F.weekday(F.trunc(d, "year"))) / 7) + 1).cast("int")
    raise ValueError(period)


def time_period_list(c: Column, period: str) -> Column:
    return F.transform(c, lambda x: time_period(x, period).cast("double"))


def time_period_map(c: Column, period: str) -> Column:
    return F.transform_values(c, lambda k, v: time_period(v, period).cast("long"))


def unit_circle(ms: Column, period: str) -> Column:
    """(cos, sin) of the period's place in its cycle; (0, 0) for null."""
    least, most = PERIODS[period]
    angle = 2 * math.pi * (time_period(ms, period) - least) / most
    return F.array(F.coalesce(F.cos(angle), F.lit(0.0)), F.coalesce(F.sin(angle), F.lit(0.0)))


def days_between(ms: Column, reference: int) -> Column:
    """Whole days to the reference, toward zero."""
    return F.when(F.lit(reference) >= ms, F.floor((F.lit(reference) - ms) / DAY_MS)).otherwise(-F.floor((ms - F.lit(reference)) / DAY_MS))


def to_date_list(ms: Column) -> Column:
    return F.when(ms.isNotNull(), F.array(ms))


def parse_any(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy")) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def most_frequent(values: Column) -> Column:
    """Mode of an array, ties to the smallest."""

    def of(own: Column) -> Column:
        counted = F.transform(F.array_sort(F.array_distinct(own)), lambda v: F.struct((-F.size(F.filter(own, lambda x: x == v))).alias("n"), v.alias("v")))
        return F.array_min(counted)["v"]

    return let(values, of)


def date_list_pivot(c: Column, pivot: str, reference: int) -> Column:
    """SinceFirst or SinceLast: whole days to the reference, then a null slot; ModeDay, ModeMonth, ModeHour: one-hot
    of the most frequent value, then a null slot."""
    null = F.when(c.isNull() | (F.size(c) <= 0), 1.0).otherwise(0.0)
    if pivot in ("SinceFirst", "SinceLast"):
        edge = F.array_min(c) if pivot == "SinceFirst" else F.array_max(c)
        return F.array(F.coalesce(days_between(edge, reference).cast("double"), F.lit(0.0)), null)
    period, size, first = {"ModeDay": ("DayOfWeek", 7, 1), "ModeMonth": ("MonthOfYear", 12, 1), "ModeHour": ("HourOfDay", 24, 0)}[pivot]
    mode = most_frequent(F.transform(c, lambda x: time_period(x, period)))
    return F.array(*[F.when(mode == i + first, 1.0).otherwise(0.0) for i in range(size)], null)
