"""Hold-outs, folds and the balance of classes. Rows are dealt by a hash of their key, so that runs repeat and engines agree."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42


def apart(seed: int | str, use: str) -> str:
    """A seed of its own for one use: rows that a hash has drawn are all on one side of a second draw by the same hash."""
    return f"{seed} {use}"


def unit_hash(key: Column, seed: int | str = SEED) -> Column:
    """A number in [0, 1) that the key and the seed decide."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def hold_out(df: DataFrame, key: Column, fraction: float = 0.1, seed: int | str = SEED) -> tuple[DataFrame, DataFrame]:
    """(training, test)."""
    u = unit_hash(key, seed)
    return df.where(u >= fraction), df.where(u < fraction)


def folds(df: DataFrame, key: Column, k: int = 3, seed: int | str = SEED, name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.floor(unit_hash(key, seed) * k).cast("int"))


def sampled(df: DataFrame, key: Column, fraction: float, seed: int = SEED) -> DataFrame:
    """A share of the rows; with more than 1, rows are repeated, the last time in part."""
    if fraction <= 1:
        return df.where(unit_hash(key, seed) < fraction)
    whole = int(fraction)
    copies = F.lit(whole) + (unit_hash(key, seed) < fraction - whole).cast("int")
    repeated = df.withColumn("__copies", copies).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.drop("__copies", "__copy")


@dataclass(frozen=True)
class DataSplitter:
    """Takes all training rows, or samples down to a greatest number of them if one is given."""

    reserve: float = 0.1
    max_rows: float = math.inf
    seed: int = SEED

    def prepare(self, df: DataFrame, key: Column, label: str) -> tuple[DataFrame, dict]:
        n = df.count()
        f = min(1.0, self.max_rows / n) if n else 1.0
        return (df if f >= 1 else sampled(df, key, f, self.seed)), {"rows": n, "down_sample": f}


def proportions(small: float, big: float, fraction: float, max_rows: int) -> tuple[float, float]:
    """(down-sampling of the larger class, up-sampling of the smaller one) for the smaller to make up `fraction`."""
    if small >= max_rows * fraction:
        return (1 - fraction) * max_rows / big, max_rows * fraction / small

    def fits(times: int) -> bool:
        return times * small * (1 - fraction) < fraction * big and max_rows * fraction > small * times

    # fixed values: the factors that are tried
    up = next((float(t) for t in (100, 50, 10, 5, 4, 3, 2) if fits(t)), 1.0)
    return (small * up / fraction - small * up) / big, up


@dataclass(frozen=True)
class DataBalancer:
    """Re-samples a binary label so that the rarer class makes up at least `fraction`."""

    fraction: float = 0.1
    reserve: float = 0.1
    max_rows: float = math.inf
    seed: int = SEED

    def prepare(self, df: DataFrame, key: Column, label: str) -> tuple[DataFrame, dict]:
        n = {r[0]: r[1] for r in df.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect()}
        pos, neg = n.get(1, 0), n.get(0, 0)
        small, big = min(pos, neg), max(pos, neg)
        total = pos + neg
        if not total or small / total >= self.fraction or not small:
            f = min(1.0, self.max_rows / total) if total else 1.0
            return (df if f >= 1 else sampled(df, key, f, self.seed)), {"positive": pos, "negative": neg, "up": 0.0, "down": f}
        down, up = proportions(small, big, self.fraction, self.max_rows)
        rare = 1 if pos < neg else 0
        out = sampled(df.where(F.col(label) == rare), key, up, self.seed).unionByName(sampled(df.where(F.col(label) == 1 - rare), key, down, self.seed))
        return out, {"positive": pos, "negative": neg, "up": up, "down": down}


@dataclass(frozen=True)
class DataCutter:
    """Keeps the most frequent labels (count descending, label ascending) with at least a share of the rows."""

    max_labels: int = 100
    min_fraction: float = 0.0
    reserve: float = 0.1
    max_rows: float = math.inf
    seed: int = SEED

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        counts = df.groupBy(label).count()
        total = counts.agg(F.sum("count")).first()[0] or 1
        return counts.where(F.col("count") / total >= self.min_fraction).orderBy(F.desc("count"), label).limit(self.max_labels)

    def prepare(self, df: DataFrame, key: Column, label: str) -> tuple[DataFrame, dict]:
        kept = [r[0] for r in self.kept(df, label).collect()]
        out = df.where(F.col(label).isin(*kept)) if kept else df.limit(0)
        n = out.count()
        f = min(1.0, self.max_rows / n) if n else 1.0
        return (out if f >= 1 else sampled(out, key, f, self.seed)), {"kept": kept, "down_sample": f}
