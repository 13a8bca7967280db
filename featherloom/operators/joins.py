"""Joins of key frames, and aggregation inside a window after a join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregators import Agg, ByKey, fold, most

KINDS = ("outer", "left_outer", "inner")


def join_keyed(left: DataFrame, right: DataFrame, how: str = "outer", left_key: str = "key", right_key: str = "key", result: str = "combined") -> DataFrame:
    """Equi-join of two frames. `combined`: the key is the left one, or the right one where that is null; `parent_child` (the
    left key meets a column of the right) and `child_parent` (the other way round): the right key goes. Column names besides
    the keys differ."""
    if how not in KINDS:
        raise ValueError(f"joins are {', '.join(KINDS)}")
    hidden = "__right_key"
    right = right.withColumnRenamed(right_key, hidden)
    out = left.join(right, F.col(left_key) == F.col(hidden), how)
    if result == "combined":
        out = out.withColumn(left_key, F.coalesce(left_key, hidden))
    return out.drop(hidden)


def join_all(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """Left-deep join of key frames: (frame, kind of the join with what stands before it)."""
    out = frames[0][0]
    for frame, how in frames[1:]:
        out = join_keyed(out, frame, how)
    return out


def cogroup_lists(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str) -> DataFrame:
    """(key, left values, right values) for every key of either side, each list in order."""
    a = left.groupBy(key).agg(F.array_sort(F.collect_list(left_value)).alias("left_values"))
    b = right.groupBy(key).agg(F.array_sort(F.collect_list(right_value)).alias("right_values"))
    none = lambda c, f: F.coalesce(c, F.array().cast(f.schema[c].dataType))
    return a.join(b, key, "outer").select(key, none("left_values", a).alias("left_values"), none("right_values", b).alias("right_values"))


@dataclass(frozen=True)
class JoinedFeature:
    name: str
    value: Column
    agg: Agg | ByKey | None = None  # None: a value of the parent, the same in all its rows
    response: bool = False
    window_ms: int | None = None


def window_after_join(joined: DataFrame, key: str, condition_ms: Column, primary_ms: Column, features: list[JoinedFeature], window_ms: int, tie: Column | None = None) -> DataFrame:
    """Aggregate joined rows per key inside a window around each key's condition time. Both edges far from the condition
    are outside: predictors count cut - w < t < cut, responses cut <= t < cut + w; null times count as 0."""
    t, cut = F.coalesce(primary_ms, F.lit(0)), F.coalesce(condition_ms, F.lit(0))
    items = []
    for f in features:
        w = f.window_ms if f.window_ms is not None else window_ms
        ok = (t >= cut) & (t < cut + w) if f.response else (t < cut) & (t > cut - w)
        items.append((f.name, f.agg or most, F.when(ok, f.value) if f.agg else f.value))
    return fold(joined, key, items, t, F.lit(0) if tie is None else tie)
