"""Raw-feature filter: distributions of raw features in training and scoring data, and which features to leave out.

A raw feature is a column, or one key of a map column. All features of a data set are summarised by one aggregation and their
histograms counted by one grouped aggregation; only histograms (bins, not rows) come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.vectorizers import learn_keys
from ..types import TYPES, infer
from .quality import correlation

#: Scoring rows below which the scoring data are not compared.
MIN_SCORING_ROWS = 500


@dataclass(frozen=True)
class FilterParams:
    bins: int = 100
    min_fill: float = 0.001
    max_fill_difference: float = 0.90
    max_fill_ratio: float = 20.0
    max_js_divergence: float = 0.90
    max_correlation: float = 0.95
    protected: tuple[str, ...] = ()
    protected_js: tuple[str, ...] = ()


@dataclass
class Distribution:
    feature: str
    key: str | None
    count: int
    nulls: int
    histogram: dict[int, float] = field(default_factory=dict)
    summary: tuple = ()

    @property
    def fill_rate(self) -> float:
        return (self.count - self.nulls) / self.count if self.count else 0.0

    def fill_difference(self, other: Distribution) -> float:
        return abs(self.fill_rate - other.fill_rate)

    def fill_ratio(self, other: Distribution) -> float:
        small, large = sorted((self.fill_rate, other.fill_rate))
        return math.inf if small == 0 else large / small

    def js_divergence(self, other: Distribution) -> float:
        """Base-2 Jensen-Shannon divergence of the two histograms; nan if one is empty."""
        a_sum, b_sum = sum(self.histogram.values()), sum(other.histogram.values())
        if not a_sum or not b_sum:
            return math.nan
        out = 0.0
        for i in self.histogram.keys() | other.histogram.keys():
            a, b = self.histogram.get(i, 0) / a_sum, other.histogram.get(i, 0) / b_sum
            m = (a + b) / 2
            out += 0.5 * (a * math.log2(a / m) if a else 0.0) + 0.5 * (b * math.log2(b / m) if b else 0.0)
        return out


def raw_columns(df: DataFrame, names: list[str], keys: dict[str, list[str]] | None = None) -> dict[tuple[str, str | None], tuple[str, Column]]:
    """(feature, map key): (numeric or text, values as an array; null if there are none)."""
    maps = [n for n in names if TYPES[infer(df.schema[n])].family.startswith("map:")]
    keys = keys if keys is not None else learn_keys(df, maps) if maps else {}
    out = {}
    for n in names:
        family = TYPES[infer(df.schema[n])].family
        if family.startswith("map:"):
            for k in keys[n]:
                out[n, k] = _values(F.element_at(F.col(f"`{n}`"), F.lit(k)), family.removeprefix("map:"))
        else:
            out[n, None] = _values(F.col(f"`{n}`"), family)
    return out


def _values(c: Column, family: str) -> tuple[str, Column]:
    if family in ("real", "integral", "binary", "date"):
        return "numeric", F.when(c.isNotNull(), F.array(c.cast("double")))
    if family in ("datelist", "location", "vector"):
        return "numeric", F.when(F.size(c) > 0, F.transform(c, lambda x: x.cast("double")))
    if family == "text":
        return "text", text.tokenize(c, stop_words=())
    if family == "category":
        return "text", F.when(c.isNotNull(), F.array(c))
    return "text", F.when(F.size(c) > 0, F.transform(c, lambda x: x.cast("string")))


def summaries(df: DataFrame, columns: dict) -> dict:
    """(least, greatest) value of each feature, of texts the token counts, and rows and nulls, by one aggregation."""
    aggs = [F.count("*").alias("n")]
    for i, (kind, v) in enumerate(columns.values()):
        x = (lambda f, v=v: f(v)) if kind == "numeric" else (lambda f, v=v: F.size(v).cast("double"))
        aggs += [F.min(x(F.array_min)).alias(f"a{i}"), F.max(x(F.array_max)).alias(f"b{i}"), F.count(v).alias(f"c{i}")]
    row = df.agg(*aggs).first()
    return {k: (row[f"a{i}"], row[f"b{i}"], row["n"], row["n"] - row[f"c{i}"]) for i, k in enumerate(columns)}


def _bin(kind: str, x: Column, ends: tuple, bins: int) -> Column:
    """Bin of a value: equal steps from the least to the greatest, the last one for what lies outside; texts by hash."""
    lo, hi = ends[:2]
    if kind == "text":
        return F.pmod(F.hash(x), F.lit(bins))
    if lo is None:
        return F.lit(0)
    if lo == hi:
        return F.when(x == lo, 0).otherwise(1)
    step = (hi - lo) / (bins - 2)
    at = F.floor((x - lo) / step).cast("int")
    return F.when((x >= lo) & (x <= lo + step * (bins - 1)), F.least(at, F.lit(bins - 2))).otherwise(bins - 1)


def distributions(df: DataFrame, names: list[str], bins: int, training: dict | None = None, keys: dict | None = None) -> dict:
    """(feature, key): Distribution. The bins' ends come from `training` (its summaries) if given."""
    columns = raw_columns(df, names, keys)
    own = summaries(df, columns)
    ends = training or own
    every = F.array(
        *[F.struct(F.lit(i).alias("f"), F.transform(v, _binner(kind, ends[k], bins)).alias("bins")) for i, (k, (kind, v)) in enumerate(columns.items())]
    )
    counts = df.select(F.explode(every).alias("x")).select("x.f", F.explode("x.bins").alias("bin")).groupBy("f", "bin").count()
    out = [Distribution(f, k, own[f, k][2], own[f, k][3], {}, ends[f, k][:2]) for f, k in columns]
    for r in counts.collect():
        out[r["f"]].histogram[r["bin"]] = float(r["count"])
    return {(d.feature, d.key): d for d in out}


def _binner(kind: str, ends: tuple, bins: int):
    return lambda x: _bin(kind, x, ends, bins).cast("int")


def null_correlations(df: DataFrame, names: list[str], labels: list[str], keys: dict | None = None) -> dict:
    """Largest absolute correlation of a feature's null flag with a numeric label."""
    columns = raw_columns(df, names, keys)
    aggs = [correlation(v.isNull().cast("double"), F.col(y)) for _, v in columns.values() for y in labels]
    row = list(df.agg(*aggs).first()) if aggs else []
    out = {}
    for i, k in enumerate(columns):
        found = [min(1.0, abs(c)) for c in row[i * len(labels) : (i + 1) * len(labels)] if c is not None and not math.isnan(c)]
        out[k] = max(found, default=None)
    return out


@dataclass
class Verdict:
    feature: str
    key: str | None
    train_fill: float
    score_fill: float | None
    null_correlation: float | None
    js_divergence: float | None
    fill_difference: float | None
    fill_ratio: float | None
    reasons: list[str]

    @property
    def excluded(self) -> bool:
        return bool(self.reasons)


def judge(train: dict, score: dict | None, correlations: dict, params: FilterParams = FilterParams()) -> list[Verdict]:
    """Six reasons to leave a feature out, all with strict thresholds."""
    out = []
    for k, t in train.items():
        s = score.get(k) if score else None
        corr = correlations.get(k)
        js, diff, ratio = (t.js_divergence(s), t.fill_difference(s), t.fill_ratio(s)) if s else (None, None, None)
        tests = {
            "training fill rate": t.fill_rate < params.min_fill,
            "null flag leaks the label": corr is not None and corr > params.max_correlation,
            "scoring fill rate": s is not None and s.fill_rate < params.min_fill,
            "divergence": js is not None and js > params.max_js_divergence and k[0] not in params.protected_js,
            "fill difference": diff is not None and diff > params.max_fill_difference,
            "fill ratio": ratio is not None and ratio > params.max_fill_ratio,
        }
        reasons = [] if k[0] in params.protected else [n for n, bad in tests.items() if bad]
        out.append(Verdict(*k, t.fill_rate, s.fill_rate if s else None, corr, js, diff, ratio, reasons))
    return out


def filter_raw(train: DataFrame, names: list[str], labels: list[str] = [], score: DataFrame | None = None, params: FilterParams = FilterParams()) -> tuple[DataFrame, list[str], dict[str, list[str]], list[Verdict]]:
    """(training data without the bad features, features dropped, map keys dropped, verdicts). A map loses its bad keys, and
    goes as a whole when none is left. Scoring data of fewer than MIN_SCORING_ROWS rows are not compared."""
    maps = [n for n in names if TYPES[infer(train.schema[n])].family.startswith("map:")]
    keys = learn_keys(train, maps) if maps else {}
    own = distributions(train, names, params.bins, keys=keys)
    if score is not None and score.limit(MIN_SCORING_ROWS).count() < MIN_SCORING_ROWS:
        score = None
    ends = {k: d.summary for k, d in own.items()}
    other = distributions(score, names, params.bins, ends, keys) if score is not None else None
    verdicts = judge(own, other, null_correlations(train, names, labels, keys) if labels else {}, params)
    bad_keys: dict[str, list[str]] = {}
    dropped = [v.feature for v in verdicts if v.excluded and v.key is None]
    for v in verdicts:
        if v.excluded and v.key is not None:
            bad_keys.setdefault(v.feature, []).append(v.key)
    dropped += [n for n, ks in bad_keys.items() if len(ks) == len(keys[n])]
    bad_keys = {n: ks for n, ks in bad_keys.items() if n not in dropped}
    out = train.drop(*dropped)
    for n, ks in bad_keys.items():
        out = out.withColumn(n, F.map_filter(n, _outside(ks)))
    return out, dropped, bad_keys, verdicts


def _outside(keys: list[str]):
    return lambda k, v: ~k.isin(*keys)
