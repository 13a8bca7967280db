"""Event aggregators: from the events of a key to one value, as built-in aggregate expressions.

Each aggregator takes the value column, which is null for events that do not count, the event time and a tie-break that makes
the order total. Keys without an event that counts get the empty value: null, or 0.0 for RealNN.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import TYPES

Agg = Callable[[Column, Column, Column], Column]
# Semi-axes of the WGS84 ellipsoid in mean earth radii, the mean radius in miles, and the ranges in miles of the
# grades of accuracy of a location (0 is unknown: half the equator).
AXIS_AB, AXIS_C = 1.0011188539924791, 0.9977622539852008
EARTH_MILES = 3959.0
ACCURACY_MILES = {1: 0.005, 2: 0.02, 3: 0.05, 4: 0.15, 5: 0.4, 6: 1.2, 7: 3.0, 8: 12.0, 9: 40.0, 10: 150.0, 0: 12450.5}


@dataclass(frozen=True)
class ByKey:
    """Aggregates the entries of maps (or the elements of vectors) key by key: entries() takes a value apart into an array of
    struct(key, value), `value` aggregates what a key has, present() puts the sorted array of results together. Rows are
    aggregated by (event key, map key) first, so that no task gathers the maps of an event key."""

    value: Agg
    entries: Callable[[Column], Column] = F.map_entries
    present: Callable[[Column], Column] = F.map_from_entries


def _ordered(v: Column, ts: Column, tie: Column) -> Column:
    """The counting values in event order: collected as (time, tie-break, value) and sorted."""
    return F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(ts.alias("t"), tie.alias("i"), v.alias("v"))))), lambda x: x["v"])


def total(v, ts, tie):
    return F.sum(v)


def total_nn(v, ts, tie):
    return F.coalesce(F.sum(v), F.lit(0.0))


def least(v, ts, tie):
    return F.min(v)


def most(v, ts, tie):
    return F.max(v)


def least_nn(v, ts, tie):
    return F.coalesce(F.min(v), F.lit(math.inf))


def most_nn(v, ts, tie):
    return F.coalesce(F.max(v), F.lit(-math.inf))


def mean(v, ts, tie):
    return F.avg(v)


def mean_nn(v, ts, tie):
    return F.coalesce(F.avg(v), F.lit(0.0))


def _clamped(v: Column) -> Column:
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def mean_percent(v, ts, tie):
    return F.avg(_clamped(v))


def any_true(v, ts, tie):
    return F.bool_or(v)


def all_true(v, ts, tie):
    return F.bool_and(v)


def odd_true(v, ts, tie):
    return F.sum(v.cast("int")) % 2 == 1


def concat(sep: str) -> Agg:
    def agg(v, ts, tie):
        return F.nullif(F.array_join(_ordered(F.when(v != "", v), ts, tie), sep), F.lit(""))

    return agg


def mode(v, ts, tie):
    """Most frequent, ties to the smallest."""
    return F.mode(v, True)


def union_set(v, ts, tie):
    out = F.array_sort(F.array_distinct(F.flatten(F.collect_set(v))))
    return F.when(F.size(out) > 0, out)


def concat_list(v, ts, tie):
    out = F.flatten(_ordered(v, ts, tie))
    return F.when(F.size(out) > 0, out)


def least_of_list(v, ts, tie):
    x = F.min(F.array_min(v))
    return F.when(x.isNotNull(), F.array(x))


def most_of_list(v, ts, tie):
    x = F.max(F.array_max(v))
    return F.when(x.isNotNull(), F.array(x))


def _elements(v: Column) -> Column:
    return F.transform(v, lambda x, i: F.struct(i.alias("key"), x.alias("value")))


#: Element-wise sum; a shorter vector has nothing to add at its missing places.
sum_vector = ByKey(total, _elements, lambda e: F.transform(e, lambda x: x["value"]))


def _xyz(v: Column) -> tuple[Column, Column, Column]:
    """The point of the ellipsoid in the direction of a location, in mean earth radii."""
    lat, lon = F.radians(F.get(v, F.lit(0))), F.radians(F.get(v, F.lit(1)))
    x, y, z = F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)
    far = 1 / F.sqrt((x * x + y * y) / AXIS_AB**2 + z * z / AXIS_C**2)
    return x * far, y * far, z * far


def _graded(c: Column, pairs) -> Column:
    out = F.lit(None).cast("double")
    for test, value in reversed(list(pairs)):
        out = F.when(test(c), F.lit(float(value))).otherwise(out)
    return out


def midpoint(v, ts, tie):
    """Mean of the points, put back on the surface. Its accuracy is the finest grade that spans the box of all points with
    their own ranges (the box's height does not count the ranges)."""
    half = _graded(F.get(v, F.lit(2)), [(lambda c, g=g: c == g, m / EARTH_MILES / 2) for g, m in ACCURACY_MILES.items()])
    x, y, z = _xyz(v)
    width = F.greatest(F.max(x + half) - F.min(x - half), F.max(y + half) - F.min(y - half), F.max(z - half) - F.min(z - half))
    grade = F.coalesce(_graded(width * EARTH_MILES * 0.99, [(lambda c, m=m: c <= m, g) for g, m in ACCURACY_MILES.items()]), F.lit(0.0))
    x, y, z = F.avg(x), F.avg(y), F.avg(z)
    lat, lon = F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))
    return F.when(F.count(v) > 0, F.array(lat, lon, grade))


def first(v, ts, tie):
    """Earliest value; of equal times the one seen last."""
    return F.min_by(v, F.when(v.isNotNull(), F.struct(ts, -tie)))


def last(v, ts, tie):
    """Latest value; of equal times the one seen first. Events before the epoch never count."""
    return F.max_by(v, F.when(v.isNotNull() & (ts > 0), F.struct(ts, -tie)))


sum_map, mean_map, mean_percent_map = ByKey(total), ByKey(mean), ByKey(mean_percent)
min_map, max_map, or_map = ByKey(least), ByKey(most), ByKey(any_true)
set_map, midpoint_map = ByKey(union_set), ByKey(midpoint)


def concat_map(sep: str) -> ByKey:
    return ByKey(concat(sep))


def _registry() -> dict[str, Agg | ByKey]:
    out: dict[str, Agg | ByKey] = {"SumReal": total, "SumCurrency": total, "SumIntegral": total, "SumRealNN": total_nn}
    for n in ("Real", "Currency", "Integral", "Date", "DateTime"):
        out |= {f"Max{n}": most, f"Min{n}": least}
    out |= {"MaxRealNN": most_nn, "MinRealNN": least_nn, "MeanReal": mean, "MeanRealNN": mean_nn, "MeanCurrency": mean, "MeanPercent": mean_percent}
    out |= {"LogicalOr": any_true, "LogicalXor": odd_true, "LogicalAnd": all_true, "ModePickList": mode, "UnionMultiPickList": union_set}
    names = ("Base64", "ComboBox", "Email", "ID", "Phone", "Text", "TextArea", "URL", "Country", "State", "City", "PostalCode", "Street")
    for n in names:
        out[f"Concat{n}"] = concat(" " if n in ("Text", "TextArea") else ",")
    for n in ("TextList", "DateList", "DateTimeList"):
        out[f"Concat{n}"] = concat_list
    for n in ("DateList", "DateTimeList"):
        out |= {f"Max{n}": most_of_list, f"Min{n}": least_of_list}
    out |= {"CombineVector": concat_list, "SumVector": sum_vector, "GeolocationMidpoint": midpoint}
    out |= {"UnionCurrencyMap": sum_map, "UnionRealMap": sum_map, "UnionIntegralMap": sum_map}
    out |= {"UnionMeanCurrencyMap": mean_map, "UnionMeanRealMap": mean_map, "UnionMeanPercentMap": mean_percent_map, "UnionMeanPrediction": mean_map}
    for n in ("Real", "Currency", "Integral", "Date", "DateTime"):
        out |= {f"UnionMax{n}Map": max_map, f"UnionMin{n}Map": min_map}
    for n in (*names, "PickList"):
        out[f"UnionConcat{n}Map"] = concat_map(" " if n in ("Text", "TextArea") else ",")
    out |= {"UnionConcatNameStats": concat_map(","), "UnionBinaryMap": or_map, "UnionMultiPickListMap": set_map, "UnionGeolocationMidpointMap": midpoint_map}
    for n in TYPES:
        if n != "Prediction":
            short = n.removeprefix("OP")
            out |= {f"First{short}": first, f"Last{short}": last}
    return out


AGGREGATORS = _registry()


def default_aggregator(ftype: str) -> Agg | ByKey:
    return AGGREGATORS[TYPES[ftype].aggregator]


def custom(zero, plus: Callable[[Column, Column], Column], present: Callable[[Column], Column] = lambda c: c) -> Agg:
    """A monoid of one's own, folded over the values in event order."""

    def agg(v, ts, tie):
        return present(F.aggregate(_ordered(v, ts, tie), zero if isinstance(zero, Column) else F.lit(zero), plus))

    return agg


def fold(rows: DataFrame, key: str, items: list[tuple[str, Agg | ByKey, Column]], ts: Column, tie: Column) -> DataFrame:
    """(key, one column for each item (name, aggregator, value)): plain aggregators share one aggregation; each key-wise one
    has its own, by key and map key, which is joined to it on the key."""
    plain = [a(v, ts, tie).alias(n) for n, a, v in items if not isinstance(a, ByKey)]
    out = rows.groupBy(key).agg(*plain) if plain else rows.select(key).distinct()
    for n, a, v in items:
        if isinstance(a, ByKey):
            parts = rows.select(F.col(key), ts.alias("__t"), tie.alias("__i"), F.explode(a.entries(v)).alias("__e"))
            value = F.col("__e.value")
            one = parts.groupBy(key, F.col("__e.key").alias("__k")).agg(a.value(value, F.col("__t"), F.col("__i")).alias("__v"))
            entry = F.when(F.col("__v").isNotNull(), F.struct(F.col("__k").alias("key"), F.col("__v").alias("value")))
            whole = one.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("__x"))
            whole = whole.select(key, F.when(F.size("__x") > 0, a.present(F.col("__x"))).alias(n))
            out = out.join(whole, key, "left")
    return out.select(key, *[n for n, _, _ in items])
