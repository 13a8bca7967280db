"""Encoders: typed columns to slots of a feature vector, each slot with its provenance.

An encoder is fitted by one aggregation (or one grouped count) over the data; what it has learned is plain JSON, and its
slots are column expressions made from that. So a fitted encoder can be saved, and works on batch and streaming frames alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, net, text
from ..types import TYPES, infer
from .aggregators import midpoint

TOP_K = 20
MIN_SUPPORT = 10
HASHES = 512
#: Hash buckets of all columns together beyond which they share one space.
MAX_HASHES = 1 << 17
MAX_CARDINALITY = 30
MIN_COVERAGE = 0.9
OTHER, NULL = "OTHER", "NullIndicatorValue"
CIRCULAR = ("HourOfDay", "DayOfWeek", "DayOfMonth", "DayOfYear")


@dataclass(frozen=True, eq=False)
class Block:
    """Hash buckets that are counted in one pass over the tokens."""

    tokens: Column
    size: int


@dataclass(frozen=True, eq=False)
class Slot:
    """One place in the vector: the feature it comes from, the map key or group, what it indicates, and its expression."""

    parent: str
    ftype: str
    expr: Column | None
    grouping: str | None = None
    indicator: str | None = None
    descriptor: str | None = None
    block: Block | None = None
    index: int = 0

    @property
    def name(self) -> str:
        return "_".join(x for x in (self.parent, self.grouping, self.indicator or self.descriptor) if x)

    def provenance(self) -> dict:
        keys = ("parent", "ftype", "grouping", "indicator", "descriptor")
        return {k: getattr(self, k) for k in keys if getattr(self, k) is not None} | {"name": self.name}


@dataclass(frozen=True)
class Encoder:
    """A fitted encoder of some columns of one type."""

    kind: str
    names: list[str]
    ftype: str
    options: dict = field(default_factory=dict)
    state: dict = field(default_factory=dict)

    def slots(self) -> list[Slot]:
        return KINDS[self.kind][1](self.names, self.ftype, self.state, **self.options)

    def to_json(self) -> dict:
        return asdict(self)


def fit(df: DataFrame, kind: str, names: list[str], ftype: str, **options) -> Encoder:
    learn = KINDS[kind][0]
    return Encoder(kind, names, ftype, options, learn(df, names, ftype, **options) if learn else {})


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _null_slot(name: str, ftype: str, is_null: Column, grouping: str | None = None) -> Slot:
    return Slot(name, ftype, _flag(is_null), grouping or name, NULL)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# numbers


def _filled(v: Column, fill: str | float) -> Column:
    return F.avg(v) if fill == "mean" else F.mode(v, True) if fill == "mode" else F.max(F.lit(float(fill)))


def _fit_numeric(df, names, ftype, fill="mean", track_nulls=True) -> dict:
    row = df.agg(*[_filled(_c(n).cast("double"), fill).alias(f"f{i}") for i, n in enumerate(names)]).first()
    return {"fill": [float(x) if x is not None else 0.0 for x in row]}


def _numeric_slots(names, ftype, state, fill="mean", track_nulls=True) -> list[Slot]:
    """[value or fill, null flag] for each column; fill: mean, mode (ties to the smallest) or a constant."""
    out = []
    for n, f in zip(names, state["fill"], strict=True):
        out.append(Slot(n, ftype, F.coalesce(_c(n).cast("double"), F.lit(f))))
        if track_nulls:
            out.append(_null_slot(n, ftype, _c(n).isNull()))
    return out


def _binary_slots(names, ftype, state, fill=False, track_nulls=True) -> list[Slot]:
    return _numeric_slots(names, ftype, {"fill": [float(fill)] * len(names)}, track_nulls=track_nulls)


# pivots


def top_values(df: DataFrame, columns: dict[str, Column], top_k: int, min_support: int) -> dict[str, list[str]]:
    """The most frequent values of each column of arrays (count descending, value ascending), in one job for all columns.
    Counts are aggregated in part before the shuffle; at most top_k values a column come back."""
    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), c.alias("v")) for n, c in columns.items()]))
    rows = df.select(pairs.alias("x")).select("x.f", F.explode("x.v").alias("v")).where("v is not null")
    counts = rows.groupBy("f", "v").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    # the best of each of many parts, then the best of those: no task ranks all values of a column
    order = [F.desc("n"), F.asc("v")]
    part = Window.partitionBy("f", F.pmod(F.hash("v"), F.lit(64))).orderBy(*order)
    best = counts.withColumn("r", F.row_number().over(part)).where(F.col("r") <= top_k)
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("f").orderBy(*order))).where(F.col("r") <= top_k)
    out: dict[str, list[str]] = {n: [] for n in columns}
    for r in sorted(ranked.collect(), key=lambda r: (r["f"], r["r"])):
        out[r["f"]].append(r["v"])
    return out


#: What a pivot takes from a value first, by name.
DERIVED: dict[str, Callable[[Column], Column]] = {"email_domain": net.email_domain, "url_domain": net.url_domain, "mime_type": net.mime_type}


def _pivoted(c: Column, is_set: bool, clean: bool, derive: str | None) -> Column:
    c = DERIVED[derive](c) if derive else c
    if is_set:
        return F.array_distinct(F.transform(c, text.clean)) if clean else c
    return F.when(c.isNotNull(), F.array(text.clean(c) if clean else c))


def _one_hot(name: str, ftype: str, values: Column, top: list[str], grouping: str, is_set: bool, track_nulls: bool) -> list[Slot]:
    """Slots of a pivot over an array of values: OTHER is a flag for texts and a count for sets."""
    out = [Slot(name, ftype, F.coalesce(_flag(F.array_contains(values, v)), F.lit(0.0)), grouping, v) for v in top]
    known = F.array(*[F.lit(v) for v in top]).cast("array<string>")
    rest = F.size(F.array_except(values, known))
    other = F.when(values.isNull(), 0.0).otherwise(rest.cast("double") if is_set else _flag(rest > 0))
    out.append(Slot(name, ftype, other, grouping, OTHER))
    if track_nulls:
        out.append(_null_slot(name, ftype, values.isNull() | (F.size(values) <= 0), grouping))
    return out


def _fit_pivot(df, names, ftype, top_k=TOP_K, min_support=MIN_SUPPORT, clean=True, track_nulls=True, derive=None, max_unique=1.0) -> dict:
    values = {n: _pivoted(_c(n), ftype == "MultiPickList", clean, derive) for n in names}
    top = top_values(df, values, top_k, min_support)
    if max_unique < 1.0:  # columns with too large a share of distinct values keep none
        row = df.agg(*[(F.approx_count_distinct(v, 0.02) / F.count(v)).alias(f"u{i}") for i, v in enumerate(values.values())]).first()
        top = {n: [] if row[i] is not None and row[i] > max_unique else top[n] for i, n in enumerate(names)}
    return {"top": top}


def _pivot_slots(names, ftype, state, top_k=TOP_K, min_support=MIN_SUPPORT, clean=True, track_nulls=True, derive=None, max_unique=1.0) -> list[Slot]:
    """One-hot of the most frequent values of texts or sets, then OTHER and null."""
    is_set = ftype == "MultiPickList"
    return [s for n in names for s in _one_hot(n, ftype, _pivoted(_c(n), is_set, clean, derive), state["top"][n], n, is_set, track_nulls)]


# hashes


def _hash_block(name: str, ftype: str, tokens: Column, hashes: int, prefix: str, grouping: str | None = None) -> list[Slot]:
    block = Block(F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.concat(F.lit(prefix), t)), hashes)
    return [Slot(name, ftype, None, grouping, descriptor=f"hash_{i}", block=block, index=i) for i in range(hashes)]


def _tokens(name: str, ftype: str) -> Column:
    c = _c(name)
    family = TYPES[ftype].family
    if family in ("list", "set"):
        return c
    if family == "map:text":
        return F.flatten(F.transform(F.map_values(c), lambda v: F.coalesce(text.tokenize(v), F.array().cast("array<string>"))))
    if family == "map:set":
        return F.flatten(F.map_values(c))
    if family.startswith("map:"):
        return F.transform(F.map_entries(c), lambda e: F.concat_ws("_", e["key"], e["value"].cast("string")))
    if family in ("vector", "datelist"):
        return F.transform(c, lambda x: x.cast("string"))
    return text.tokenize(c)


def _hash_slots(names, ftype, state, hashes=HASHES, track_nulls=True, shared: bool | None = None) -> list[Slot]:
    """Token counts in hash buckets, for lists, sets, maps, vectors or texts; each column has buckets of its own unless they
    share one space, which they do on their own beyond MAX_HASHES buckets."""
    shared = hashes * len(names) > MAX_HASHES if shared is None else shared
    out = []
    if shared:
        every = F.flatten(F.array(*[F.transform(F.coalesce(_tokens(n, ftype), F.array().cast("array<string>")), _prefixed(n)) for n in names]))
        out = _hash_block("_".join(names), ftype, every, hashes, "")
    for n in names:
        if not shared:
            out += _hash_block(n, ftype, _tokens(n, ftype), hashes, f"{n}_")
        if track_nulls:
            out.append(_null_slot(n, ftype, _c(n).isNull()))
    return out


def _prefixed(name: str) -> Callable[[Column], Column]:
    return lambda t: F.concat(F.lit(f"{name}_"), t)


# texts


def text_statistics(df: DataFrame, columns: dict[str, Column], max_cardinality: int, top_k: int) -> dict[str, dict]:
    """count, distinct values, share of the top_k values and standard deviation of the length of each text column."""
    aggs = []
    for i, c in enumerate(columns.values()):
        v = text.clean(c)
        aggs += [F.count(v).alias(f"n{i}"), F.approx_count_distinct(v, 0.02).alias(f"d{i}"), F.coalesce(F.stddev_pop(F.length(c)), F.lit(0.0)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    out = {n: {"count": row[f"n{i}"], "distinct": row[f"d{i}"], "length_std": row[f"s{i}"], "covered": 0.0} for i, n in enumerate(columns)}
    many = [n for n in columns if out[n]["distinct"] > max_cardinality and out[n]["count"]]
    if many:
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("f"), text.clean(columns[n]).alias("v")) for n in many])).alias("x")).select("x.*").where("v is not null")
        counts = rows.groupBy("f", "v").count()
        order = [F.desc("count"), F.asc("v")]
        part = counts.withColumn("r", F.row_number().over(Window.partitionBy("f", F.pmod(F.hash("v"), F.lit(64))).orderBy(*order))).where(F.col("r") <= top_k)
        best = part.withColumn("r", F.row_number().over(Window.partitionBy("f").orderBy(*order))).where(F.col("r") <= top_k).groupBy("f").agg(F.sum("count").alias("k"))
        for r in best.collect():
            out[r["f"]]["covered"] = r["k"] / out[r["f"]]["count"]
    return out


def choose_method(stats: dict, max_cardinality: int, coverage: float, min_length_std: float) -> str:
    """pivot a column of few values or whose top values cover most rows; ignore one whose lengths hardly vary; hash the rest."""
    if stats["distinct"] <= max_cardinality or stats["covered"] >= coverage:
        return "pivot"
    return "ignore" if stats["length_std"] < min_length_std else "hash"


def _fit_smart(df, names, ftype, max_cardinality=MAX_CARDINALITY, top_k=TOP_K, min_support=MIN_SUPPORT, coverage=MIN_COVERAGE, min_length_std=0.0, hashes=HASHES, track_nulls=True) -> dict:
    stats = text_statistics(df, {n: _c(n) for n in names}, max_cardinality, top_k)
    method = {n: choose_method(stats[n], max_cardinality, coverage, min_length_std) for n in names}
    few = [n for n in names if method[n] == "pivot"]
    return {"method": method, "top": _fit_pivot(df, few, ftype, top_k, min_support)["top"] if few else {}}


def _smart_slots(names, ftype, state, max_cardinality=MAX_CARDINALITY, top_k=TOP_K, min_support=MIN_SUPPORT, coverage=MIN_COVERAGE, min_length_std=0.0, hashes=HASHES, track_nulls=True) -> list[Slot]:
    by = {m: [n for n in names if state["method"][n] == m] for m in ("pivot", "hash", "ignore")}
    out = _pivot_slots(by["pivot"], ftype, state, track_nulls=track_nulls)
    out += _hash_slots(by["hash"], ftype, {}, hashes, track_nulls) if by["hash"] else []
    return out + ([_null_slot(n, ftype, _c(n).isNull()) for n in by["ignore"]] if track_nulls else [])


# maps


#: Different keys that the map columns of an encoder may have.
MAX_KEYS = 100_000


def learn_keys(df: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """The keys of each map column, in order, by one distinct over all columns' keys. Each key becomes slots of the vector, so that
    their number is bounded: more than MAX_KEYS are an error."""
    out: dict[str, list[str]] = {n: [] for n in names}
    if names:
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.map_keys(_c(n)).alias("k")) for i, n in enumerate(names)]))
        found = df.select(pairs.alias("x")).select("x.f", F.explode("x.k").alias("k")).distinct().limit(MAX_KEYS + 1).collect()
        if len(found) > MAX_KEYS:
            raise ValueError(f"the maps {names} have more than {MAX_KEYS} different keys")
        for r in found:
            out[names[r["f"]]].append(r["k"])
    return {n: sorted(k) for n, k in out.items()}


def _at(name: str, key: str, reference_ms: int | None = None) -> Column:
    v = F.element_at(_c(name), F.lit(key))
    return dates.days_between(v, reference_ms) if reference_ms is not None else v


def _fit_map_values(df, names, ftype, fill=0.0, track_nulls=True, reference_ms=None) -> dict:
    keys = learn_keys(df, names)
    every = [(n, k) for n in names for k in keys[n]]
    fills = list(df.agg(*[_filled(_at(n, k, reference_ms).cast("double"), fill).alias(f"f{i}") for i, (n, k) in enumerate(every)]).first()) if every else []
    found = {(n, k): float(f) if f is not None else 0.0 for (n, k), f in zip(every, fills, strict=True)}
    return {"keys": keys, "fill": {n: [found[n, k] for k in keys[n]] for n in names}}


def _map_value_slots(names, ftype, state, fill=0.0, track_nulls=True, reference_ms=None) -> list[Slot]:
    """[value or fill, null flag] for each learned key of numeric, boolean or date maps."""
    out = []
    for n in names:
        for k, f in zip(state["keys"][n], state["fill"][n], strict=True):
            v = _at(n, k, reference_ms).cast("double")
            out.append(Slot(n, ftype, F.coalesce(v, F.lit(f)), k))
            if track_nulls:
                out.append(_null_slot(n, ftype, v.isNull(), k))
    return out


def _fit_map_pivot(df, names, ftype, top_k=TOP_K, min_support=MIN_SUPPORT, clean=True, track_nulls=True, derive=None) -> dict:
    keys = learn_keys(df, names)
    is_set = ftype == "MultiPickListMap"
    return {"keys": keys, "top": {n: top_values(df, {k: _pivoted(_at(n, k), is_set, clean, derive) for k in keys[n]}, top_k, min_support) for n in names}}


def _map_pivot_slots(names, ftype, state, top_k=TOP_K, min_support=MIN_SUPPORT, clean=True, track_nulls=True, derive=None) -> list[Slot]:
    """Pivot of the values of each learned key, of text maps or maps of sets."""
    is_set = ftype == "MultiPickListMap"
    return [s for n in names for k in state["keys"][n] for s in _one_hot(n, ftype, _pivoted(_at(n, k), is_set, clean, derive), state["top"][n][k], k, is_set, track_nulls)]


def _fit_smart_map(df, names, ftype, max_cardinality=MAX_CARDINALITY, top_k=TOP_K, min_support=MIN_SUPPORT, coverage=MIN_COVERAGE, min_length_std=0.0, hashes=HASHES, track_nulls=True) -> dict:
    keys = learn_keys(df, names)
    method, top = {}, {}
    for n in names:
        stats = text_statistics(df, {k: _at(n, k) for k in keys[n]}, max_cardinality, top_k) if keys[n] else {}
        method[n] = {k: choose_method(stats[k], max_cardinality, coverage, min_length_std) for k in keys[n]}
        top[n] = top_values(df, {k: _pivoted(_at(n, k), False, True, None) for k in keys[n] if method[n][k] == "pivot"}, top_k, min_support)
    return {"keys": keys, "method": method, "top": top}


def _smart_map_slots(names, ftype, state, max_cardinality=MAX_CARDINALITY, top_k=TOP_K, min_support=MIN_SUPPORT, coverage=MIN_COVERAGE, min_length_std=0.0, hashes=HASHES, track_nulls=True) -> list[Slot]:
    out = []
    for n in names:
        for k in state["keys"][n]:
            method = state["method"][n][k]
            if method == "pivot":
                out += _one_hot(n, ftype, _pivoted(_at(n, k), False, True, None), state["top"][n][k], k, False, track_nulls)
            else:
                if method == "hash":
                    out += _hash_block(n, ftype, text.tokenize(_at(n, k)), hashes, f"{n}_{k}_", k)
                if track_nulls:
                    out.append(_null_slot(n, ftype, _at(n, k).isNull(), k))
    return out


def _fit_keys(df, names, ftype, **options) -> dict:
    return {"keys": learn_keys(df, names)}


def _map_length_slots(names, ftype, state) -> list[Slot]:
    return [Slot(n, ftype, text.token_length(text.tokenize(_at(n, k))), k, descriptor="TextLen") for n in names for k in state["keys"][n]]


def _map_null_slots(names, ftype, state) -> list[Slot]:
    return [_null_slot(n, ftype, text.tokenize(_at(n, k)).isNull(), k) for n in names for k in state["keys"][n]]


def _map_circle_slots(names, ftype, state, period="HourOfDay") -> list[Slot]:
    return [Slot(n, ftype, F.get(dates.unit_circle(_at(n, k), period), F.lit(i)), k, descriptor=f"{'xy'[i]}_{period}") for n in names for k in state["keys"][n] for i in (0, 1)]


# places and dates


def _fit_location(df, names, ftype, track_nulls=True) -> dict:
    row = df.agg(*[midpoint(_c(n), F.lit(0), F.lit(0)).alias(f"m{i}") for i, n in enumerate(names)]).first()
    return {"fill": [list(x) if x else [0.0, 0.0, 0.0] for x in row]}


def _location_slots(names, ftype, state, track_nulls=True) -> list[Slot]:
    """[latitude, longitude, accuracy, null flag]; nulls become the midpoint."""
    out = []
    for n, fill in zip(names, state["fill"], strict=True):
        out += _place(n, ftype, _c(n), fill, n, track_nulls)
    return out


def _place(n: str, ftype: str, c: Column, fill: list[float], grouping: str, track_nulls: bool) -> list[Slot]:
    out = [Slot(n, ftype, F.coalesce(F.get(c, F.lit(i)), F.lit(float(fill[i]))), grouping, descriptor=d) for i, d in enumerate(("lat", "lon", "accuracy"))]
    return out + ([_null_slot(n, ftype, c.isNull(), grouping)] if track_nulls else [])


def _fit_map_location(df, names, ftype, track_nulls=True) -> dict:
    keys = learn_keys(df, names)
    every = [(n, k) for n in names for k in keys[n]]
    row = list(df.agg(*[midpoint(_at(n, k), F.lit(0), F.lit(0)).alias(f"m{i}") for i, (n, k) in enumerate(every)]).first()) if every else []
    found = {nk: list(x) if x else [0.0, 0.0, 0.0] for nk, x in zip(every, row, strict=True)}
    return {"keys": keys, "fill": {n: [found[n, k] for k in keys[n]] for n in names}}


def _map_location_slots(names, ftype, state, track_nulls=True) -> list[Slot]:
    return [s for n in names for k, f in zip(state["keys"][n], state["fill"][n], strict=True) for s in _place(n, ftype, _at(n, k), f, k, track_nulls)]


def _circle_slots(names, ftype, state, periods=CIRCULAR) -> list[Slot]:
    return [Slot(n, ftype, F.get(dates.unit_circle(_c(n), p), F.lit(k)), p, descriptor=f"{'xy'[k]}_{p}") for n in names for p in periods for k in (0, 1)]


def _days_slots(names, ftype, state, reference_ms=0, track_nulls=True) -> list[Slot]:
    out = []
    for n in names:
        out.append(Slot(n, ftype, F.coalesce(dates.days_between(_c(n), reference_ms).cast("double"), F.lit(0.0)), descriptor="days_since"))
        if track_nulls:
            out.append(_null_slot(n, ftype, _c(n).isNull()))
    return out


def _date_list_slots(names, ftype, state, pivot="SinceLast", reference_ms=0) -> list[Slot]:
    out = []
    size = {"ModeDay": 7, "ModeMonth": 12, "ModeHour": 24}.get(pivot, 1)
    for n in names:
        v = dates.date_list_pivot(_c(n), pivot, reference_ms)
        out += [Slot(n, ftype, F.get(v, F.lit(i)), n, descriptor=f"{pivot}_{i}") for i in range(size)]
        out.append(_null_slot(n, ftype, F.get(v, F.lit(size)) == 1.0))
    return out


def _phone_slots(names, ftype, state, region="US", track_nulls=True) -> list[Slot]:
    out = []
    for n in names:
        valid = net.is_valid_phone(_c(n), region)
        out.append(Slot(n, ftype, F.coalesce(valid.cast("double"), F.lit(0.0))))
        if track_nulls:
            out.append(_null_slot(n, ftype, valid.isNull()))
    return out


# trees


def tree_splits(df: DataFrame, x: Column, label: str, depth: int = 5, bins: int = 32, min_gain: float = 0.01) -> list[float]:
    """Splits of a one-feature decision tree against the label; none if the label has one value or no split gains enough."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(x.cast("double").alias("x"), _c(label).cast("double").alias("label")).where("x is not null and label is not null")
    if rows.select("label").distinct().limit(2).count() < 2:
        return []
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    tree = DecisionTreeClassifier(maxDepth=depth, maxBins=bins, minInfoGain=min_gain, impurity="gini", seed=1).fit(rows)
    return sorted({float(x) for x in re.findall(r"feature 0 <= ([-0-9.E]+)", tree.toDebugString)})


def _buckets(n: str, ftype: str, x: Column, splits: list[float], grouping: str, track_nulls: bool) -> list[Slot]:
    """One-hot slots of right-inclusive buckets, then null; without splits the null slot alone."""
    out = []
    if splits:
        edges = [float("-inf"), *splits, float("inf")]
        for a, b in zip(edges, edges[1:], strict=False):
            out.append(Slot(n, ftype, F.coalesce(_flag((x > a) & (x <= b)), F.lit(0.0)), grouping, f"{a}-{b}"))
    return out + ([_null_slot(n, ftype, x.isNull(), grouping)] if track_nulls else [])


def _fit_tree(df, names, ftype, label, depth=5, bins=32, min_gain=0.01, track_nulls=True) -> dict:
    return {"splits": {n: tree_splits(df, _c(n), label, depth, bins, min_gain) for n in names}}


def _tree_slots(names, ftype, state, label, depth=5, bins=32, min_gain=0.01, track_nulls=True) -> list[Slot]:
    return [s for n in names for s in _buckets(n, ftype, _c(n).cast("double"), state["splits"][n], n, track_nulls)]


def _fit_map_tree(df, names, ftype, label, depth=5, bins=32, min_gain=0.01, track_nulls=True) -> dict:
    """A tree for each map key, fitted side by side."""
    from concurrent.futures import ThreadPoolExecutor

    keys = learn_keys(df, names)
    every = [(n, k) for n in names for k in keys[n]]
    with ThreadPoolExecutor(8) as pool:
        found = dict(zip(every, pool.map(lambda nk: tree_splits(df, _at(*nk), label, depth, bins, min_gain), every), strict=True))
    return {"keys": keys, "splits": {n: [found[n, k] for k in keys[n]] for n in names}}


def _map_tree_slots(names, ftype, state, label, depth=5, bins=32, min_gain=0.01, track_nulls=True) -> list[Slot]:
    return [s for n in names for k, x in zip(state["keys"][n], state["splits"][n], strict=True) for s in _buckets(n, ftype, _at(n, k).cast("double"), x, k, track_nulls)]


#: kind: (what it learns from the data, if anything; its slots)
KINDS: dict[str, tuple[Callable | None, Callable]] = {
    "numeric": (_fit_numeric, _numeric_slots),
    "binary": (None, _binary_slots),
    "pivot": (_fit_pivot, _pivot_slots),
    "hash": (None, _hash_slots),
    "smart_text": (_fit_smart, _smart_slots),
    "map_values": (_fit_map_values, _map_value_slots),
    "map_pivot": (_fit_map_pivot, _map_pivot_slots),
    "smart_map": (_fit_smart_map, _smart_map_slots),
    "map_length": (_fit_keys, _map_length_slots),
    "map_null": (_fit_keys, _map_null_slots),
    "map_circle": (_fit_keys, _map_circle_slots),
    "map_location": (_fit_map_location, _map_location_slots),
    "map_tree": (_fit_map_tree, _map_tree_slots),
    "location": (_fit_location, _location_slots),
    "circle": (None, _circle_slots),
    "days": (None, _days_slots),
    "date_list": (None, _date_list_slots),
    "phone": (None, _phone_slots),
    "tree": (_fit_tree, _tree_slots),
}


def default_encoders(ftype: str, reference_ms: int, top: dict, hashes: int) -> list[tuple[str, dict]]:
    """(kind, options) of the encoders that a type has by default."""
    family = TYPES[ftype].family
    derived = {"Email": "email_domain", "URL": "url_domain", "Base64": "mime_type"}
    if ftype in derived:
        return [("pivot", top | {"derive": derived[ftype]})]
    if ftype in ("EmailMap", "URLMap", "Base64Map"):
        return [("map_pivot", top | {"derive": derived[ftype.removesuffix("Map")]})]
    if ftype == "Phone":
        return [("phone", {})]
    by_family: dict[str, list[tuple[str, dict]]] = {
        "binary": [("binary", {})],
        "integral": [("numeric", {"fill": "mode"})],
        "real": [("numeric", {"fill": "mean", "track_nulls": TYPES[ftype].nullable})],
        "date": [("circle", {}), ("days", {"reference_ms": reference_ms})],
        "text": [("smart_text", top | {"hashes": hashes})],
        "category": [("pivot", top)],
        "set": [("pivot", top)],
        "list": [("hash", {"hashes": hashes})],
        "datelist": [("date_list", {"reference_ms": reference_ms})],
        "location": [("location", {})],
        "map:real": [("map_values", {"fill": "mean"})],
        "map:integral": [("map_values", {"fill": "mode"})],
        "map:binary": [("map_values", {})],
        "map:date": [("map_values", {"reference_ms": reference_ms})],
        "map:set": [("map_pivot", top)],
        "map:location": [("map_location", {})],
        "map:text": [("smart_map", top | {"hashes": hashes}) if ftype in ("TextMap", "TextAreaMap") else ("map_pivot", top)],
    }
    if family not in by_family:
        raise TypeError(f"no default encoding for {ftype}")
    return by_family[family]


def auto_encode(df: DataFrame, names: list[str] | None = None, *, label: str | None = None, reference_ms: int = 0, top_k: int = TOP_K, min_support: int = MIN_SUPPORT, hashes: int = HASHES) -> list[Encoder]:
    """Default encoders of all columns by type, types in order of their names; with a label, numbers also get tree buckets."""
    by: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if (names is None or f.name in names) and f.name != label:
            by.setdefault(infer(f), []).append(f.name)
    top = {"top_k": top_k, "min_support": min_support}
    out = [fit(df, kind, by[t], t, **o) for t in sorted(by) for kind, o in default_encoders(t, reference_ms, top, hashes)]
    if label:
        out += [fit(df, "tree", by[t], t, label=label) for t in sorted(by) if TYPES[t].family in ("real", "integral")]
        out += [fit(df, "map_tree", by[t], t, label=label) for t in sorted(by) if TYPES[t].family in ("map:real", "map:integral")]
    return out


def slots_of(encoders: list[Encoder]) -> list[Slot]:
    return [s for e in encoders for s in e.slots()]


def assemble(df: DataFrame, slots: list[Slot], name: str = "features") -> DataFrame:
    """df with the slots as one array of doubles, and their provenance in the column's metadata. Hash buckets are counted by
    one pass over their tokens."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    parts: list[Column] = []
    run: list[Column] = []
    blocks: dict[int, str] = {}
    df_out, i = df, 0
    while i < len(slots):
        block = slots[i].block
        if block is None:
            run.append(slots[i].expr)
            i += 1
            continue
        if id(block) not in blocks:
            k = len(blocks)
            blocks[id(block)] = f"__h{k}"
            df_out = HashingTF(inputCol=f"__t{k}", outputCol=f"__h{k}", numFeatures=block.size).transform(df_out.withColumn(f"__t{k}", block.tokens)).drop(f"__t{k}")
        counts = vector_to_array(F.col(blocks[id(block)]))
        n = 0
        while i + n < len(slots) and slots[i + n].block is block and slots[i + n].index == slots[i].index + n:
            n += 1
        if run:
            parts.append(F.array(*run))
            run = []
        parts.append(counts if n == block.size else F.slice(counts, slots[i].index + 1, n))
        i += n
    if run or not parts:
        parts.append(F.array(*run).cast("array<double>"))
    out = df_out.withColumn(name, F.concat(*parts)).drop(*blocks.values())
    return out.withMetadata(name, {"slots": [s.provenance() for s in slots]})


def encode(df: DataFrame, encoders: list[Encoder], name: str = "features") -> DataFrame:
    return assemble(df, slots_of(encoders), name)


def drop_slots(df: DataFrame, drop: Callable[[dict], bool], name: str = "features") -> DataFrame:
    """The vector without the slots whose provenance `drop` holds true for."""
    slots = df.schema[name].metadata["slots"]
    return keep_slots(df, [i for i, s in enumerate(slots) if not drop(s)], name)


#: Slots up to which kept ones are picked one by one.
_PICKED = 200


def keep_slots(df: DataFrame, keep: list[int], name: str = "features", out: str | None = None) -> DataFrame:
    """The slots of a vector at the places `keep`, in ascending order.

    The vector is never named inside a lambda function: the optimizer would put the expression that makes it there, and it would be
    evaluated again for every slot.
    """
    if any(a >= b for a, b in zip(keep, keep[1:], strict=False)):
        raise ValueError("slots are kept in ascending order")
    slots = df.schema[name].metadata["slots"]
    v = F.col(name)
    if len(keep) == len(slots):
        kept = v
    elif len(keep) <= _PICKED:
        kept = F.array(*[F.get(v, F.lit(i)) for i in keep]).cast("array<double>")
    else:
        kept = F.filter(v, lambda x, i: i.isin(keep))
    return df.withColumn(out or name, kept).withMetadata(out or name, {"slots": [slots[i] for i in keep]})


def combine(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    slots = [s for n in names for s in df.schema[n].metadata.get("slots", [])]
    return df.withColumn(out, F.concat(*[F.col(n) for n in names])).withMetadata(out, {"slots": slots})
