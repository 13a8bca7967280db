"""Evaluation of predictions by aggregation. What comes to the driver is bounded by classes, bins and thresholds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct labels up to which per-class figures are made.
MAX_CLASSES = 10_000


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def _f1(p: float, r: float) -> float:
    return _ratio(2 * p * r, p + r)


def score_counts(df: DataFrame, label: str, score: str, bins: int) -> list[tuple[float, int, int]]:
    """(score, positives, negatives) by falling score. More than `bins` distinct scores are gathered between quantiles; a
    gathered group goes by its least score."""
    rows = df.select(F.col(score).cast("double").alias("s"), (F.col(label) > 0).cast("long").alias("y")).where("s is not null and y is not null")
    many = rows.agg(F.approx_count_distinct("s")).first()[0] > 2 * bins
    found = [] if many else rows.groupBy("s").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    if many:
        edges = sorted(set(rows.agg(F.percentile_approx("s", [i / bins for i in range(bins)], 100 * bins)).first()[0]))
        at = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("s")))
        found = rows.groupBy(at.alias("b")).agg(F.min("s").alias("s"), F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    return sorted(((r["s"], r["p"], r["n"] - r["p"]) for r in found), reverse=True)


def curves(counts: list[tuple[float, int, int]]) -> dict:
    """Counts and rates at each threshold, and the areas under the two curves."""
    tp = np.cumsum([c[1] for c in counts]) if counts else np.zeros(0)
    fp = np.cumsum([c[2] for c in counts]) if counts else np.zeros(0)
    pos, neg = (int(tp[-1]), int(fp[-1])) if counts else (0, 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        recall = tp / pos if pos else np.zeros(len(tp))
        fpr = fp / neg if neg else np.zeros(len(fp))
        precision = tp / (tp + fp)
    area = lambda x, y: float(((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum())
    roc = area(np.r_[0.0, fpr, 1.0], np.r_[0.0, recall, 1.0]) if counts else 0.0
    pr = area(np.r_[0.0, recall], np.r_[precision[:1], precision]) if counts else 0.0
    return {
        "thresholds": [c[0] for c in counts], "precision": precision.tolist(), "recall": recall.tolist(), "false_positive_rate": fpr.tolist(),
        "tp": tp.tolist(), "fp": fp.tolist(), "tn": (neg - fp).tolist(), "fn": (pos - tp).tolist(), "au_roc": roc, "au_pr": pr,
    }


def binary(df: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "probability", bins: int = 100) -> dict:
    """Confusion counts, precision, recall, F1, error, areas under the curves, and the curves. All 0 without rows."""
    y, p = F.col(label) > 0, F.col(prediction) > 0
    row = df.agg(*[F.count_if(t).alias(n) for n, t in (("tp", y & p), ("tn", ~y & ~p), ("fp", ~y & p), ("fn", y & ~p))]).first()
    tp, tn, fp, fn = (row[n] for n in ("tp", "tn", "fp", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    curve = curves(score_counts(df, label, score, bins))
    out = {"precision": precision, "recall": recall, "f1": _f1(precision, recall), "error": _ratio(fp + fn, tp + tn + fp + fn), "tp": tp, "tn": tn, "fp": fp, "fn": fn}
    return out | {"au_roc": curve["au_roc"], "au_pr": curve["au_pr"], "curves": curve}


def bin_scores(df: DataFrame, label: str = "label", score: str = "probability", bins: int = 100) -> DataFrame:
    """(bin, center, n, positives, mean_score, rate, squared_error) of the bins that have rows; bins are equal parts between the
    least score (0 at most) and the greatest (1 at least)."""
    s = F.col(score).cast("double")
    lo, hi = df.agg(F.coalesce(F.least(F.min(s), F.lit(0.0)), F.lit(0.0)), F.coalesce(F.greatest(F.max(s), F.lit(1.0)), F.lit(1.0))).first()
    at = F.least(F.lit(bins - 1), F.floor(bins * (s - lo) / (hi - lo)).cast("int"))
    y = F.col(label).cast("double")
    return df.groupBy(at.alias("bin")).agg(
        F.count("*").alias("n"), F.sum((y > 0).cast("long")).alias("positives"), F.avg(s).alias("mean_score"), F.avg((y > 0).cast("double")).alias("rate"), F.sum((s - y) * (s - y)).alias("squared_error")
    ).withColumn("center", F.lit(lo) + (F.col("bin") + 0.5) * ((hi - lo) / bins))


def brier(df: DataFrame, label: str = "label", score: str = "probability") -> float:
    d = F.col(score) - F.col(label)
    return df.agg(F.avg(d * d)).first()[0] or 0.0


def confusion(df: DataFrame, label: Column, prediction: Column) -> dict[tuple[float, float], int]:
    """Counts by (label, prediction); more than MAX_CLASSES classes of a side are an error."""
    counts = df.groupBy(label.cast("double").alias("y"), prediction.cast("double").alias("p")).count().limit(MAX_CLASSES * 100 + 1).collect()
    if len(counts) > MAX_CLASSES * 100:
        raise ValueError("too many classes for a confusion matrix")
    return {(r["y"], r["p"]): r["count"] for r in counts}


def weighted(table: dict[tuple[float, float], int]) -> dict:
    """Precision and recall weighted by the labels' shares, F1 of those two, and the error."""
    total = sum(table.values())
    labels = {y for y, _ in table}
    by_label = {c: sum(n for (y, _), n in table.items() if y == c) for c in labels}
    by_pred: dict[float, int] = {}
    for (_, p), n in table.items():
        by_pred[p] = by_pred.get(p, 0) + n
    precision = sum(by_label[c] * _ratio(table.get((c, c), 0), by_pred.get(c, 0)) for c in labels) / total if total else 0.0
    recall = sum(table.get((c, c), 0) for c in labels) / total if total else 0.0
    return {"precision": precision, "recall": recall, "f1": _f1(precision, recall), "error": 1 - recall if total else 0.0}


def top_classes(df: DataFrame, label: str, k: int) -> list[float]:
    """The k most frequent labels, ties by label."""
    return [r["y"] for r in df.groupBy(F.col(label).cast("double").alias("y")).count().orderBy(F.desc("count"), "y").limit(k).collect()]


def multi(df: DataFrame, label: str = "label", prediction: str = "prediction") -> dict:
    return weighted(confusion(df, F.col(label), F.col(prediction)))


def multi_top_k(df: DataFrame, label: str = "label", prediction: str = "prediction", ks: tuple[int, ...] = (5, 10, 20, 50, 100)) -> list[dict]:
    """Weighted figures with the labels outside of the k most frequent as one class, -1."""
    table = confusion(df, F.col(label), F.col(prediction))
    n: dict[float, int] = {}
    for (y, _), c in table.items():
        n[y] = n.get(y, 0) + c
    order = sorted(n, key=lambda y: (-n[y], y))
    out = []
    for k in ks:
        kept = set(order[:k])
        merged: dict[tuple[float, float], int] = {}
        for (y, p), c in table.items():
            at = (y if y in kept else -1.0, p)
            merged[at] = merged.get(at, 0) + c
        out.append({"k": k} | weighted(merged))
    return out


def thresholds_multi(df: DataFrame, label: str = "label", probability: str = "probability", top_ns: tuple[int, ...] = (1, 3), thresholds: list[float] | None = None) -> list[dict]:
    """For each n and threshold: rows whose label is among the n best and has a score of at least the threshold (correct), rows
    whose best score reaches it otherwise (incorrect), and the rest (no_prediction). probability: an array of doubles."""
    at = thresholds or [i / 100 for i in range(101)]
    steps = F.array(*[F.lit(float(t)) for t in at])
    p, y = F.col(probability), F.col(label).cast("int")
    mine = F.coalesce(F.get(p, y), F.lit(0.0))

    def below(x: Column) -> Column:
        """Thresholds before the first that lies above x."""
        first = F.array_position(F.transform(steps, lambda t: t > x), True)
        return F.when(first > 0, first - 1).otherwise(len(at)).cast("int")

    order = F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    best = F.transform(order, lambda e: e["i"])
    cols = [F.array_contains(F.slice(best, 1, n), y).alias(f"in{n}") for n in top_ns]
    rows = df.select(below(mine).alias("own"), below(F.array_max(p)).alias("top"), *cols).groupBy("own", "top", *[f"in{n}" for n in top_ns]).count().collect()
    out = []
    for n in top_ns:
        correct, wrong = np.zeros(len(at), int), np.zeros(len(at), int)
        total = 0
        for r in rows:
            total += r["count"]
            cut = r["own"] if r[f"in{n}"] else 0
            correct[:cut] += r["count"]
            wrong[cut : r["top"]] += r["count"]
        out += [{"top_n": n, "threshold": t, "correct": int(c), "incorrect": int(w), "no_prediction": int(total - c - w)} for t, c, w in zip(at, correct, wrong, strict=True)]
    return out


def confusion_by_threshold(df: DataFrame, label: str = "label", prediction: str = "prediction", probability: str = "probability", classes: int = 15, thresholds: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """(threshold, label, prediction, n) among the most frequent classes, of rows whose best score reaches the threshold."""
    kept = top_classes(df, label, classes)
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    rows = df.where(y.isin(*kept) & p.isin(*kept)).select(y.alias("label"), p.alias("prediction"), F.array_max(probability).alias("s"))
    reached = F.filter(F.array(*[F.lit(float(t)) for t in sorted(thresholds)]), lambda t: t <= F.col("s"))
    counts = rows.withColumn("n_reached", F.size(reached)).groupBy("label", "prediction", "n_reached").agg(F.count("*").alias("n"))
    each = F.explode(F.slice(F.array(*[F.lit(float(t)) for t in sorted(thresholds)]), F.lit(1), F.col("n_reached")))
    return counts.where("n_reached > 0").withColumn("threshold", each).groupBy("threshold", "label", "prediction").agg(F.sum("n").alias("n"))


def misclassified(df: DataFrame, label: str = "label", prediction: str = "prediction", most: int = 5) -> DataFrame:
    """(side, category, total, correct, other, n): the most frequent wrong classes for each label and for each prediction."""
    pairs = df.groupBy(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")).agg(F.count("*").alias("n"))
    out = None
    for side, a, b in (("label", "y", "p"), ("prediction", "p", "y")):
        whole = Window.partitionBy(a)
        rows = pairs.withColumns({"total": F.sum("n").over(whole), "correct": F.coalesce(F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))).over(whole), F.lit(0))})
        wrong = rows.where(F.col("y") != F.col("p")).withColumn("r", F.row_number().over(Window.partitionBy(a).orderBy(F.desc("n"), b))).where(F.col("r") <= most)
        part = wrong.select(F.lit(side).alias("side"), F.col(a).alias("category"), "total", "correct", F.col(b).alias("other"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def regression(df: DataFrame, label: str = "label", prediction: str = "prediction") -> dict:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    row = df.agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("var")).first()
    mse = row["mse"] or 0.0
    return {"rmse": math.sqrt(mse), "mse": mse, "mae": row["mae"] or 0.0, "r2": 1 - mse / row["var"] if row["var"] else 0.0}


def error_histogram(df: DataFrame, label: str = "label", prediction: str = "prediction", edges: list[float] | None = None, cutoff: float = 1e-3, smart_ratio: float | None = None) -> DataFrame:
    """(bin, low, n): signed percentage errors between edges, the last bin closed; labels near 0 count as the cut-off."""
    edges = edges or [-math.inf, *[float(x) for x in range(-100, 101, 10)], math.inf]
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    if smart_ratio is not None:
        cutoff = max(cutoff, smart_ratio * (df.agg(F.avg(F.abs(y))).first()[0] or 0.0))
    e = 100 * (p - y) / F.greatest(F.abs(y), F.lit(cutoff))
    ends = F.array(*[F.lit(x) for x in edges])
    at = F.least(F.size(F.filter(ends, lambda x: x <= F.col("e"))), F.lit(len(edges) - 1)) - 1
    counts = df.select(e.alias("e")).where("e is not null").groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.where("bin >= 0").select("bin", F.get(ends, F.col("bin")).alias("low"), "n")


def forecast(df: DataFrame, order: list[str], label: str = "label", prediction: str = "prediction", season: int = 1, max_items: int = 87_660) -> dict:
    """SMAPE, seasonal error and MASE of at most max_items rows in the given order (a bounded window)."""
    y, p = F.col("y"), F.col("p")
    rows = df.select(*order, F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")).orderBy(*order).limit(max_items)
    rows = rows.withColumn("later", F.lead("y", season).over(Window.orderBy(*order)))
    sums = F.abs(y) + F.abs(p)
    row = rows.agg(
        F.count("*").alias("n"), F.sum(F.when(sums > 0, F.abs(y - p) / sums).otherwise(0.0)).alias("s"), F.sum(F.abs(y - F.col("later"))).alias("d"), F.sum(F.abs(y - p)).alias("e")
    ).first()
    n = row["n"]
    seasonal = (row["d"] or 0.0) / (n - season) if n > season else math.nan
    scale = seasonal * n
    return {"smape": 2 * row["s"] / n if n else 0.0, "seasonal_error": seasonal, "mase": row["e"] / scale if scale > 0 else 0.0}


def log_loss(df: DataFrame, label: str = "label", probability: str = "probability") -> float:
    """Mean of -ln of the label's probability."""
    p = F.get(F.col(probability), F.col(label).cast("int"))
    return df.agg(F.avg(-F.ln(p))).first()[0]


#: name: (function of (df, label, prediction, probability) to a number, larger is better)
METRICS = {
    "au_roc": (lambda d, y, p, s: curves(score_counts(d, y, s, 1000))["au_roc"], True),
    "au_pr": (lambda d, y, p, s: curves(score_counts(d, y, s, 1000))["au_pr"], True),
    "precision": (lambda d, y, p, s: binary(d, y, p, s)["precision"], True),
    "recall": (lambda d, y, p, s: binary(d, y, p, s)["recall"], True),
    "f1": (lambda d, y, p, s: binary(d, y, p, s)["f1"], True),
    "brier": (lambda d, y, p, s: brier(d, y, s), False),
    "error": (lambda d, y, p, s: multi(d, y, p)["error"], False),
    "multi_f1": (lambda d, y, p, s: multi(d, y, p)["f1"], True),
    "rmse": (lambda d, y, p, s: regression(d, y, p)["rmse"], False),
    "mse": (lambda d, y, p, s: regression(d, y, p)["mse"], False),
    "mae": (lambda d, y, p, s: regression(d, y, p)["mae"], False),
    "r2": (lambda d, y, p, s: regression(d, y, p)["r2"], True),
}


def custom(name: str, larger_better: bool, fn) -> str:
    """Register a metric of one's own: fn(df, label, prediction, probability) -> float."""
    METRICS[name] = (fn, larger_better)
    return name
