"""Sanity checks of a feature vector against a label: variance, correlation, association, rule confidence."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correlation(x: Column, y: Column) -> Column:
    """Pearson's over the rows that have both; null where one of them does not vary."""
    x, y = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def contingency(df: DataFrame, group: str, label: str) -> DataFrame:
    """(value, label, n)."""
    return df.groupBy(F.col(group).alias("value"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def _margins(table: DataFrame) -> DataFrame:
    """The table with the sums of its rows (rn) and columns (cn)."""
    rows = table.groupBy("value").agg(F.sum("n").alias("rn"))
    cols = table.groupBy("label").agg(F.sum("n").alias("cn"))
    return table.join(rows, "value").join(cols, "label")


def cramers_v(table: DataFrame) -> DataFrame:
    """n, chi squared and Cramer's V of a table (value, label, n), without bringing it to the driver. Null with fewer than
    two rows or columns."""
    t = _margins(table.where("n > 0"))
    # chi squared = total * (sum of n^2 / (row * column) - 1)
    one = t.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n") / (F.col("rn") * F.col("cn"))).alias("s"), F.least(F.count_distinct("value"), F.count_distinct("label")).alias("k"))
    chi = F.greatest(F.col("total") * (F.col("s") - 1), F.lit(0.0))
    ok = F.col("k") > 1
    return one.select(F.col("total").alias("n"), F.when(ok, chi).alias("chi_squared"), F.when(ok, F.sqrt(chi / F.col("total") / F.when(ok, F.col("k") - 1))).alias("cramers_v"))


def pointwise_information(table: DataFrame) -> DataFrame:
    """(value, label, n, pmi): log2 of how much likelier the pair is than chance; pairs that do not occur are not listed."""
    total = table.agg(F.sum("n")).first()[0] or 0
    return _margins(table).select("value", "label", "n", F.log2(F.col("n") * F.lit(total) / (F.col("rn") * F.col("cn"))).alias("pmi"))


def mutual_information(table: DataFrame) -> float:
    """Sum of the pairs' shares times their pointwise information, in bits."""
    row = pointwise_information(table).agg(F.sum(F.col("n") * F.col("pmi")), F.sum("n")).first()
    return row[0] / row[1] if row[1] else 0.0


def rule_confidence(table: DataFrame) -> DataFrame:
    """(value, confidence, support): the largest share of one label among the rows of a value, and the value's share."""
    total = table.agg(F.sum("n")).first()[0] or 1
    per = table.groupBy("value").agg(F.max("n").alias("m"), F.sum("n").alias("k"))
    return per.select("value", (F.col("m") / F.col("k")).alias("confidence"), (F.col("k") / F.lit(total)).alias("support"))


def set_association(df: DataFrame, values: str, label: str) -> DataFrame:
    """(value, cramers_v) of a column of sets: each value's two-by-k table, the rows with it against those without."""
    labels = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("cn"))
    total = labels.agg(F.sum("cn")).first()[0] or 0
    cells = df.select(F.explode(F.array_distinct(values)).alias("value"), F.col(label).alias("label")).groupBy("value", "label").agg(F.count("*").alias("n"))
    # cells that do not occur count too: the sums over a value's cells are corrected for them
    rows = cells.groupBy("value").agg(F.sum("n").alias("rn"))
    k = labels.count()
    t = cells.join(rows, "value").join(labels, "label")
    out = F.lit(total) - F.col("rn")
    with_cell = F.col("n") * F.col("n") / (F.col("rn") * F.col("cn")) + F.pow(F.col("cn") - F.col("n"), 2) / (out * F.col("cn"))
    missing = t.groupBy("value").agg(F.sum(F.when(F.col("rn") < total, with_cell)).alias("s"), F.sum("cn").alias("seen"), F.first("rn").alias("rn"))
    s = F.col("s") + (F.lit(total) - F.col("seen")) / (F.lit(total) - F.col("rn"))
    chi = F.greatest(F.lit(total) * (s - 1), F.lit(0.0))
    return missing.select("value", F.when(F.lit(k) > 1, F.sqrt(chi / total)).alias("cramers_v"))


def correlations(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """(feature, correlation) with the label (Pearson), by one aggregation; null where nothing varies."""
    y = F.col(label).cast("double")
    row = df.agg(*[correlation(F.col(n), y).alias(f"c{i}") for i, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"c{i}").alias("correlation")) for i, n in enumerate(names)])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def vary_enough(df: DataFrame, vector: str, least: float = 1e-5) -> list[int]:
    """Slots whose sample variance is above `least`."""
    row = df.agg(Summarizer.metrics("count", "variance").summary(array_to_vector(F.col(vector))).alias("s")).first()["s"]
    return [i for i, v in enumerate(row["variance"].toArray()) if v > least] if row and row["count"] else []


@dataclass(frozen=True)
class CheckParams:
    check_sample: float = 1.0  # all rows, unless a share of them is asked for
    sample_seed: int = 42
    max_correlation: float = 0.95
    min_correlation: float = 0.0
    max_feature_correlation: float = 0.99
    min_variance: float = 1e-5
    max_cramers_v: float = 0.95
    max_rule_confidence: float = 1.0
    min_rule_support: float = 1.0
    correlation: str = "pearson"
    categorical_label: bool | None = None
    remove_bad: bool = False
    skip_hashed: bool = False  # no correlations for hash buckets
    label_only: bool = False  # correlations with the label alone, for wide vectors


@dataclass
class SlotStatistics:
    name: str
    grouping: str | None
    indicator: str | None
    mean: float
    variance: float
    least: float
    greatest: float
    correlation: float
    cramers_v: float | None = None
    confidence: float | None = None
    support: float | None = None
    reasons: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Moments:
    """Of the slots and, last, the label: mean, sample variance and extremes; corr: the correlations of all with all, or (a
    single row) with the label."""

    n: int
    mean: np.ndarray
    variance: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    corr: np.ndarray


def _means(rows: DataFrame, values: Column, n: int, running: np.ndarray) -> np.ndarray:
    """Means by sums: Summarizer's running means drift, as they are rounded at every row. Values are added as their first 24
    bits and the rest apart, so that the sums of numbers of like size are exact, or nearly so, over millions of rows. Beyond
    the range of floats the running means stay."""
    x = F.col("x")
    high = x.cast("float").cast("double")
    parts = rows.select(F.posexplode(values).alias("i", "x")).where(x != 0).groupBy("i").agg(F.sum(high).alias("high"), F.sum(x - high).alias("low"))
    sums = np.zeros(len(running))
    for r in parts.collect():
        sums[r["i"]] = r["high"] + r["low"]
    return np.where(np.isfinite(sums), sums / n, running)


def moments(df: DataFrame, vector: str, label: str, size: int, method: str = "pearson", label_only: bool = False) -> Moments:
    """Sums are added up in the JVM by tree aggregations, so that the driver gets one result, whatever the number of
    partitions: the matrix of all correlations, or with label_only a row. What does not vary has no correlation (nan)."""
    k = size + 1
    y = F.col(label).cast("double")
    values = F.concat(F.col(vector), F.array(y))
    rows = df.where(y.isNotNull()).select(array_to_vector(values).alias("v"), F.col(vector).alias("x"), y.alias("y"))
    s = rows.agg(Summarizer.metrics("count", "mean", "variance", "min", "max").summary(F.col("v")).alias("s")).first()["s"]
    if not s or not s["count"]:
        none = np.zeros(k)
        return Moments(0, none, none, np.full(k, np.inf), np.full(k, -np.inf), np.full((1 if label_only else k, k), math.nan))
    n, variance = s["count"], s["variance"].toArray()
    mean = _means(df.where(y.isNotNull()), values, n, s["mean"].toArray())
    if n < 2:
        corr = np.full((1 if label_only else k, k), math.nan)
    elif label_only and method == "pearson":
        # y is centred first, so that the sums of products are not the difference of large numbers
        off = F.transform(F.concat(F.col("x"), F.array("y")), lambda x: x * (F.col("y") - F.lit(float(mean[-1]))))
        products = rows.agg(Summarizer.mean(array_to_vector(off)).alias("m")).first()["m"].toArray()
        sd = np.sqrt(variance)
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = (products * n / (n - 1) / (sd * sd[-1]))[None]
    else:
        corr = Correlation.corr(rows, "v", method).first()[0].toArray()
        corr[variance <= 0, :] = corr[:, variance <= 0] = math.nan
        corr = corr[-1:] if label_only else corr
    return Moments(n, mean, variance, s["min"].toArray(), s["max"].toArray(), corr)


def sanity_check(df: DataFrame, vector: str, label: str, params: CheckParams = CheckParams()) -> tuple[list[SlotStatistics], list[int]]:
    """Statistics of every slot with the reasons to remove it, and the slots to keep (all unless params.remove_bad)."""
    slots = df.schema[vector].metadata["slots"]
    if params.check_sample < 1:
        n = df.count()
        df = df.sample(False, min(1.0, max(params.check_sample, 1_000 / n)), params.sample_seed) if n else df
    m = moments(df, vector, label, len(slots), params.correlation, params.label_only)
    corr = m.corr
    if params.skip_hashed:
        hashed = [i for i, s in enumerate(slots) if (s.get("descriptor") or "").startswith("hash_")]
        corr[:, hashed] = math.nan
        if len(corr) > 1:
            corr[hashed, :] = math.nan
    mine = corr[-1]
    out = [
        SlotStatistics(s["name"], s.get("grouping"), s.get("indicator"), float(m.mean[i]), float(m.variance[i]), float(m.least[i]), float(m.greatest[i]), float(mine[i]))
        for i, s in enumerate(slots)
    ]
    n = m.n
    with np.errstate(invalid="ignore"):
        near = np.tril(np.abs(corr[:-1, :-1]) > params.max_feature_correlation, -1).any(1) if len(corr) > 1 else np.zeros(len(slots), bool)
    _categorical(df, vector, label, slots, out, params, n)
    for i, s in enumerate(out):
        if s.variance <= params.min_variance:
            s.reasons.append("variance")
        c = abs(s.correlation)
        if not math.isnan(c) and c > params.max_correlation:
            s.reasons.append("correlation with the label is too high")
        if not math.isnan(c) and c < params.min_correlation:
            s.reasons.append("correlation with the label is too low")
        if near[i]:
            s.reasons.append("correlation with an earlier slot")
        if s.cramers_v is not None and s.cramers_v > params.max_cramers_v:
            s.reasons.append("association with the label")
    bad = {(slots[i]["parent"], s.grouping) for i, s in enumerate(out) if s.confidence is not None and s.confidence > params.max_rule_confidence - 1e-12 and s.support > params.min_rule_support}
    for i, s in enumerate(out):
        if (slots[i]["parent"], s.grouping) in bad and s.indicator:
            s.reasons.append("rule confidence of the group")
    keep = [i for i, s in enumerate(out) if not (params.remove_bad and s.reasons)]
    return out, keep


def _categorical(df: DataFrame, vector: str, label: str, slots: list[dict], out: list[SlotStatistics], params: CheckParams, n: int) -> None:
    """Cramer's V of each group of indicator slots, and the rule confidence of each slot, from one aggregation by label."""
    few = params.categorical_label
    if few is None:
        bound = int(min(100, 0.1 * n)) + 1
        few = df.select(label).distinct().limit(bound).count() < bound
    groups: dict[tuple, list[int]] = {}
    for i, s in enumerate(slots):
        if s.get("indicator"):
            groups.setdefault((s["parent"], s.get("grouping")), []).append(i)
    if not few or not groups:
        return
    at = [i for g in groups.values() for i in g]
    rows = df.groupBy(label).agg(*[F.sum(F.get(F.col(vector), F.lit(i))).alias(f"s{i}") for i in at]).collect()
    table = {i: np.array([r[f"s{i}"] or 0.0 for r in rows]) for i in at}
    for group in groups.values():
        t = np.array([table[i] for i in group])
        v = cramers_v_of(t)
        for i in group:
            k = table[i].sum()
            out[i].cramers_v = v
            out[i].confidence = float(table[i].max() / k) if k else 0.0
            out[i].support = float(k / n) if n else 0.0


def cramers_v_of(t: np.ndarray) -> float | None:
    """Cramer's V of a small table without its empty rows and columns."""
    t = t[t.sum(1) > 0][:, t.sum(0) > 0] if t.size else t
    if min(t.shape) < 2:
        return None
    total = t.sum()
    expected = np.outer(t.sum(1), t.sum(0)) / total
    return float(np.sqrt(((t - expected) ** 2 / expected).sum() / total / (min(t.shape) - 1)))
