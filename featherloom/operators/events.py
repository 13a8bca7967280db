"""From events to one row per key: aggregation around a global or a per-key cut-off time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregators import AGGREGATORS, Agg, ByKey, default_aggregator, fold

DAY_MS = 86_400_000


@dataclass(frozen=True)
class CutOff:
    """A cut-off time in epoch milliseconds; None: there is none, every event counts."""

    at: int | None = None

    @classmethod
    def unix_epoch(cls, ms: int) -> CutOff:
        return cls(max(0, ms))

    @classmethod
    def days_ago(cls, days: int, now_ms: int) -> CutOff:
        """Start of the UTC day so many days before now."""
        return cls((now_ms // DAY_MS - days) * DAY_MS)

    @classmethod
    def weeks_ago(cls, weeks: int, now_ms: int) -> CutOff:
        return cls.days_ago(7 * weeks, now_ms)

    @classmethod
    def ddmmyyyy(cls, text: str) -> CutOff:
        from datetime import UTC, datetime

        return cls(int(datetime.strptime(text, "%d%m%Y").replace(tzinfo=UTC).timestamp() * 1000))


@dataclass(frozen=True)
class EventFeature:
    """A feature over a key's events: how its value is taken from an event, and how values are aggregated.

    Predictors count events before the cut-off, responses those from it on. window_ms, if given, is how far from the
    cut-off an event may lie, its far edge included, and overrides the reader's.
    """

    name: str
    value: Column
    ftype: str = "Real"
    aggregator: str | Agg | ByKey | None = None
    response: bool = False
    window_ms: int | None = None

    def agg(self) -> Agg | ByKey:
        if self.aggregator is None:
            return default_aggregator(self.ftype)
        return AGGREGATORS[self.aggregator] if isinstance(self.aggregator, str) else self.aggregator


def counts(feature: EventFeature, ts: Column, cut: Column | None, window_ms: int | None) -> Column:
    """Whether an event counts for a feature."""
    if cut is None:
        return F.lit(True)
    w = feature.window_ms if feature.window_ms is not None else window_ms
    if feature.response:
        return (ts >= cut) & (ts <= cut + w) if w is not None else ts >= cut
    return (ts < cut) & (ts >= cut - w) if w is not None else ts < cut


def _rows(events: DataFrame, key: Column, ts: Column, tie: Column, features: list[EventFeature]) -> DataFrame:
    values = [f.value.alias(f"v{i}") for i, f in enumerate(features)]
    return events.select(key.cast("string").alias("key"), ts.alias("ts"), tie.alias("tie"), *values)


def _items(features: list[EventFeature], cut: Column | None, predictor_ms: int | None, response_ms: int | None) -> list[tuple]:
    out = []
    for i, f in enumerate(features):
        ok = counts(f, F.col("ts"), cut, response_ms if f.response else predictor_ms)
        out.append((f.name, f.agg(), F.when(ok, F.col(f"v{i}"))))
    return out


def aggregate_events(
    events: DataFrame,
    key: Column,
    ts: Column,
    features: list[EventFeature],
    cut_off: CutOff = CutOff(),
    tie: Column | None = None,
    predictor_window_ms: int | None = None,
    response_window_ms: int | None = None,
) -> DataFrame:
    """One row per key: (key, features). Every key of the events has a row, even if no event counts for it. One shuffle on
    the key; sums, means, extremes and the like are aggregated in part before it."""
    rows = _rows(events, key, ts, F.lit(0) if tie is None else tie, features)
    cut = None if cut_off.at is None else F.lit(cut_off.at)
    return fold(rows, "key", _items(features, cut, predictor_window_ms, response_window_ms), F.col("ts"), F.col("tie"))


@dataclass(frozen=True)
class Conditional:
    """Per-key cut-off: the time of an event that meets the condition (the first, the last, or a reproducible random one);
    keys without one are dropped, or cut off at now_ms."""

    condition: Column
    keep: str = "min"
    drop_unmet: bool = True
    now_ms: int | None = None
    predictor_window_ms: int | None = 7 * DAY_MS
    response_window_ms: int | None = 7 * DAY_MS
    seed: int = 42


def conditional_events(events: DataFrame, key: Column, ts: Column, features: list[EventFeature], how: Conditional, tie: Column | None = None) -> DataFrame:
    """One row per key, aggregated around the key's own cut-off. The cut-offs are a small aggregate that is joined to the
    events on the key; adaptive execution can broadcast it or split keys with very many events."""
    rows = events.select(
        key.cast("string").alias("key"),
        ts.alias("ts"),
        (F.lit(0) if tie is None else tie).alias("tie"),
        how.condition.alias("met"),
        *[f.value.alias(f"v{i}") for i, f in enumerate(features)],
    )
    hit = F.when(F.col("met"), F.col("ts"))
    at = {
        "min": F.min(hit),
        "max": F.max(hit),
        "random": F.min_by(hit, F.when(F.col("met"), F.xxhash64("key", "ts", F.lit(how.seed)))),
    }[how.keep]
    cuts = rows.groupBy("key").agg(at.alias("cut"))
    if how.drop_unmet:
        cuts = cuts.where("cut is not null")
    else:
        cuts = cuts.withColumn("cut", F.coalesce("cut", F.lit(how.now_ms)))
    joined = rows.join(cuts, "key")
    return fold(joined, "key", _items(features, F.col("cut"), how.predictor_window_ms, how.response_window_ms), F.col("ts"), F.col("tie"))
