"""Helpers on whole frames: predicates over all rows, splits, keyed sums, counters, histograms, and lookup of columns."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalers import at_ranks


def holds_for(df: DataFrame, condition: Column, how: str = "all") -> bool:
    """Whether a condition is true of all rows, of any, or of none; null counts as false."""
    true = F.coalesce(condition, F.lit(False))
    if how == "any":
        return not df.where(true).limit(1).isEmpty()
    if how == "none":
        return df.where(true).limit(1).isEmpty()
    return df.where(~true).limit(1).isEmpty()


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of which the condition is true, and the rest."""
    true = F.coalesce(condition, F.lit(False))
    return df.where(true), df.where(~true)


def group_count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def group_sum(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("total"))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df and a counter of its rows that is filled by whatever action runs first."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def histogram(df: DataFrame, value: Column, bins: int = 100) -> list[tuple[float, float]]:
    """(center, count) of at most `bins` bins that adapt to the values (a streaming histogram, merged across partitions)."""
    found = df.agg(F.histogram_numeric(value.cast("double"), F.lit(bins))).first()[0] or []
    return [(r["x"], r["y"]) for r in found]


def median(df: DataFrame, value: Column) -> float | None:
    """The middle value, or the mean of the two in the middle; F.median brings all distinct values to one task."""
    middle = at_ranks(df, value, lambda n: [(n + 1) // 2, n // 2 + 1])
    return sum(middle) / 2 if middle else None


def density(bins: list[tuple[float, float]], x: float) -> float:
    """Estimated share of values at or below x, linear between the centers."""
    total = sum(n for _, n in bins)
    if not total or x < bins[0][0]:
        return 0.0
    below = 0.0
    for (a, n), (b, m) in zip(bins, bins[1:], strict=False):
        if x >= b:
            below += n
            continue
        share = (x - a) / (b - a)
        at = n + (m - n) * share
        return (below + n / 2 + (n + at) * share / 2) / total
    return 1.0


def find_fields(schema: T.StructType, query: str, ignore_case: bool = True) -> list[T.StructField]:
    """Columns whose name is the query; if there are none, those that contain it; if there are none, those most like it."""
    fold = (lambda s: s.lower()) if ignore_case else (lambda s: s)
    q = fold(query)
    exact = [f for f in schema.fields if fold(f.name) == q]
    inside = [f for f in schema.fields if q in fold(f.name)]
    if exact or inside:
        return exact or inside
    scored = [(SequenceMatcher(None, q, fold(f.name)).ratio(), f) for f in schema.fields]
    best = max((s for s, _ in scored), default=0.0)
    return [f for s, f in scored if s == best and best > 0.5]
