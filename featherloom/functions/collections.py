"""Lists, sets, maps and vectors (arrays of doubles) as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

Fn = Callable[[Column], Column]


def null_if_empty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def lift_list(fn: Fn) -> Fn:
    return lambda c: null_if_empty(F.transform(c, fn))


def lift_set(fn: Fn) -> Fn:
    return lambda c: null_if_empty(F.array_sort(F.array_distinct(F.transform(c, fn))))


def lift_map(fn: Fn) -> Fn:
    return lambda c: null_if_empty(F.transform_values(c, lambda k, v: fn(v)))


def filter_map(c: Column, allow: list[str] | None = None, block: list[str] | None = None, clean_keys: bool = False) -> Column:
    """Keep or drop keys of a map, cleaned first if asked."""
    out = F.transform_keys(c, lambda k, v: clean(k)) if clean_keys else c
    if allow:
        out = F.map_filter(out, lambda k, v: k.isin(*allow))
    if block:
        out = F.map_filter(out, lambda k, v: ~k.isin(*block))
    return null_if_empty(out)


def occurs(c: Column, kind: str) -> Column:
    """1.0 if a number is above 0, a text has a character, a collection an element; else 0.0."""
    test = {"number": lambda: c > 0, "boolean": lambda: c, "text": lambda: F.length(c) > 0, "collection": lambda: F.size(c) > 0}[kind]()
    return F.when(test, 1.0).otherwise(0.0)


def replace_value(c: Column, old, new) -> Column:
    return F.when(c.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(c)


def filter_value(c: Column, predicate: Fn, default) -> Column:
    return F.when(predicate(c), c).otherwise(F.lit(default))


def labels_to_map(labels: list[str], probabilities: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), probabilities)


def top_n_map(m: Column, n: int) -> Column:
    """The n entries of greatest value, ties by key."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.map_from_entries(F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: F.struct(e["k"], -e["v"])))


def top_n_labels(labels: list[str], probabilities: Column, n: int, unseen: str = "UnseenLabel") -> Column:
    return top_n_map(F.map_filter(labels_to_map(labels, probabilities), lambda k, v: k != unseen), n)


def vector_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vector_subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vector_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_update(a: Column, index: int, value: float) -> Column:
    return F.transform(a, lambda x, i: F.when(i == index, F.lit(float(value))).otherwise(x))


def combine(*vectors: Column) -> Column:
    return F.concat(*vectors)


def prediction_parts(p: Column) -> list[Column]:
    """prediction, raw vector and probability vector of a prediction map."""

    def vector(prefix: str) -> Column:
        entries = F.filter(F.map_entries(p), lambda e: e["key"].startswith(f"{prefix}_"))
        keyed = F.transform(entries, lambda e: F.struct(F.substring_index(e["key"], "_", -1).cast("int").alias("i"), e["value"].alias("v")))
        return F.transform(F.array_sort(keyed), lambda e: e["v"])

    return [F.element_at(p, F.lit("prediction")), vector("rawPrediction"), vector("probability")]
