"""Fitted column operators that are no vectorizers: fills, scalers, calibrators and indexers. Each fit returns what it has
learned as plain JSON values; each apply makes a column from that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNSEEN, UNSEEN_INDEX, NULL_LABEL = "UnseenLabel", "UnseenIndex", "null"


def fit_mean(df: DataFrame, c: Column, default: float = 0.0) -> float:
    x = df.agg(F.avg(c.cast("double"))).first()[0]
    return default if x is None else float(x)


def fill(c: Column, value: float) -> Column:
    return F.coalesce(c.cast("double"), F.lit(float(value)))


def fit_standard(df: DataFrame, c: Column) -> dict:
    """Mean and sample standard deviation."""
    row = df.agg(F.avg(c.cast("double")), F.stddev_samp(c.cast("double"))).first()
    return {"mean": float(row[0] or 0.0), "std": float(row[1] or 0.0)}


def standardise(c: Column, fitted: dict) -> Column:
    """(c - mean) / std; 0 where nothing varies."""
    return (c.cast("double") - fitted["mean"]) / fitted["std"] if fitted["std"] else c.cast("double") * 0.0


def at_ranks(df: DataFrame, c: Column, ranks: Callable[[int], list[int]], accuracy: int = 10_000) -> list[float]:
    """The values of c at ranks, a function of how many there are that are not null, counted from 1. They are exact: an approximate
    quantile on either side of a rank says where to look, values outside are only counted, and of those inside (some n / accuracy)
    each one's copies. No task holds more than a bracket's distinct values, however many there are in all."""
    rows = df.select(c.cast("double").alias("v")).where("v is not null")
    n = rows.count()
    wanted = ranks(n) if n else []
    found: dict[int, float] = {}
    _find_ranks(rows, n, {r: r for r in wanted}, found, accuracy)
    return [found[r] for r in wanted]


def _find_ranks(rows: DataFrame, n: int, wanted: dict[int, int], found: dict[int, float], accuracy: int) -> None:
    """Puts the values of rows at the ranks of `wanted` into `found` under its keys."""
    if not wanted:
        return
    ranks = sorted(set(wanted.values()))
    shares = [min(1.0, max(0.0, r / n + off / accuracy)) for r in ranks for off in (-2, 2)]
    edges = rows.agg(F.percentile_approx("v", shares, accuracy)).first()[0]
    brackets: list[list[float]] = []
    for lo, hi in sorted(zip(edges[::2], edges[1::2], strict=True)):
        if brackets and lo <= brackets[-1][1]:
            brackets[-1][1] = max(hi, brackets[-1][1])
        else:
            brackets.append([lo, hi])
    # 2 i + 1 inside the i-th bracket, even numbers before, between and after them
    v = F.col("v")
    at = F.lit(0)
    for lo, hi in brackets:
        at = at + (v >= F.lit(lo)).cast("int") + (v > F.lit(hi)).cast("int")
    placed = rows.select("v", at.alias("at"))
    counts = {r["at"]: r["n"] for r in placed.groupBy("at").agg(F.count("*").alias("n")).collect()}
    before, own = {}, 0
    for i in range(2 * len(brackets) + 1):
        before[i] = own
        own += counts.get(i, 0)
    inside: list[Column] = []
    outside: dict[int, dict[int, int]] = {}
    where = {r: max(i for i in before if before[i] < r and counts.get(i)) for r in ranks}
    for key, r in wanted.items():
        i = where[r]
        if i % 2 == 0:
            outside.setdefault(i, {})[key] = r - before[i]
    for r, i in where.items():
        if i % 2:
            inside.append(F.struct(F.lit(i).alias("at"), F.lit(r - before[i]).cast("long").alias("rank"), F.lit(r).cast("long").alias("whole")))
    if inside:
        copies = placed.where(F.col("at").isin(*{i for i in where.values() if i % 2})).groupBy("at", "v").agg(F.count("*").alias("n"))
        last = F.sum("n").over(Window.partitionBy("at").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        hit = F.filter(F.array(*inside), lambda w: (w["at"] == F.col("at")) & (w["rank"] <= F.col("last")) & (w["rank"] > F.col("last") - F.col("n")))
        picked = copies.withColumn("last", last).select("v", F.explode(hit).alias("w")).select("v", "w.whole").collect()
        values = {r["whole"]: r["v"] for r in picked}
        found.update({key: values[r] for key, r in wanted.items() if r in values})
    for i, rest in outside.items():  # the quantiles were further off than they say
        _find_ranks(placed.where(F.col("at") == i).select("v"), counts[i], rest, found, accuracy)


def fit_percentiles(df: DataFrame, c: Column, buckets: int = 100) -> list[float]:
    """Distinct inner edges of buckets of equal counts: the least values with at least a share of all values at or below them."""
    return sorted(set(at_ranks(df, c, lambda n: [-(-n * i // buckets) for i in range(1, buckets)])))


def percentile(c: Column, edges: list[float], buckets: int = 100) -> Column:
    """The bucket of c, scaled to 0 .. buckets - 1."""
    if not edges:
        return F.when(c.isNotNull(), F.lit(0.0))
    at = F.lit(0)
    for e in edges:
        at = at + (c.cast("double") >= e).cast("int")
    return F.floor(at * ((buckets - 1) / len(edges)) + 0.5).cast("double")


def fit_isotonic(df: DataFrame, score: Column, label: Column) -> dict:
    """Boundaries and values of the isotonic regression of a label on a score."""
    from pyspark.ml.regression import IsotonicRegression

    rows = df.select(score.cast("double").alias("features"), label.cast("double").alias("label")).where("features is not null and label is not null")
    model = IsotonicRegression().fit(rows)
    return {"x": list(model.boundaries.toArray()), "y": list(model.predictions.toArray())}


def calibrate(c: Column, fitted: dict) -> Column:
    """Linear between the boundaries, flat outside."""
    x, y = fitted["x"], fitted["y"]
    out = F.lit(y[-1])
    for i in range(len(x) - 1, 0, -1):
        slope = (y[i] - y[i - 1]) / (x[i] - x[i - 1]) if x[i] > x[i - 1] else 0.0
        out = F.when(c < x[i], F.lit(y[i - 1]) + (c - x[i - 1]) * slope).otherwise(out)
    return F.when(c.isNotNull(), F.when(c <= x[0], F.lit(y[0])).otherwise(out))


def fit_labels(df: DataFrame, c: Column, keep_null: bool = True, most: int = 10_000) -> list[str]:
    """Labels by falling count, ties by label; with keep_null a null is a label of its own. More than `most` labels are an
    error, not cut off."""
    v = F.coalesce(c.cast("string"), F.lit(NULL_LABEL)) if keep_null else c.cast("string")
    counts = df.select(v.alias("v")).where("v is not null").groupBy("v").count()
    rows = counts.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels; this column is no label")
    return [r["v"] for r in sorted(rows, key=lambda r: (-r["count"], r["v"]))]


def index_labels(c: Column, labels: list[str], unseen: str = "keep", keep_null: bool = True) -> Column:
    """Index of a label. unseen: `keep` gives the next index, `skip` null, `error` fails."""
    v = F.coalesce(c.cast("string"), F.lit(NULL_LABEL)) if keep_null else c.cast("string")
    at = F.array_position(F.array(*[F.lit(x) for x in labels]).cast("array<string>"), v)
    rest = {"keep": F.lit(float(len(labels))), "skip": F.lit(None).cast("double"), "error": F.raise_error(F.lit("unseen label")).cast("double")}[unseen]
    return F.when(at > 0, (at - 1).cast("double")).otherwise(rest)


def label_at(c: Column, labels: list[str], unseen: str = UNSEEN_INDEX) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]).cast("array<string>"), c.cast("int")), F.lit(unseen))


