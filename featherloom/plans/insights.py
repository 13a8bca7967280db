"""Why a model says what it says: for the model as a whole, and for each record."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models
from .quality import SlotStatistics

TOP_K = 20
#: Decimals by which two differences of scores are told apart.
TIE_DIGITS = 8


def contributions(model, size: int) -> list[float]:
    """Coefficients or importances of the slots; zeros for models that have none."""
    if hasattr(model, "coefficientMatrix") and getattr(model, "numClasses", 2) > 2:
        return np.abs(model.coefficientMatrix.toArray()).max(0).tolist()
    for name in ("coefficients", "featureImportances"):
        if hasattr(model, name):
            return list(getattr(model, name).toArray())
    return [0.0] * size


def model_insights(selected: models.Selected, slots: list[dict], statistics: list[SlotStatistics] | None = None) -> dict:
    """Per-slot statistics and contributions, gathered by feature, and how the model was chosen."""
    weights = contributions(selected.model, len(slots))
    by = {s.name: s for s in statistics or []}
    features: dict[str, list[dict]] = {}
    for s, w in zip(slots, weights, strict=True):
        found = by.get(s["name"])
        own = {"slot": s["name"], "contribution": w}
        if found:
            own |= {"correlation": found.correlation, "variance": found.variance, "cramers_v": found.cramers_v, "reasons": found.reasons}
        features.setdefault(s["parent"], []).append(own)
    chosen = {"model": selected.name, "params": selected.params, "metric": selected.metric, "validation": selected.validation_score, "train": selected.train_score, "holdout": selected.holdout_score}
    return {"selected": chosen, "trials": [{"model": m, "params": p, "score": s} for m, p, s in selected.trials], "features": features}


def to_json(insights: dict) -> str:
    return json.dumps(insights, default=str)


def pretty(insights: dict, most: int = 15) -> str:
    rows = sorted(((s["slot"], s["contribution"]) for f in insights["features"].values() for s in f), key=lambda x: -abs(x[1]))[:most]
    return ascii_table(["slot", "contribution"], [[n, f"{w:.6f}"] for n, w in rows], insights["selected"]["model"])


def ascii_table(columns: list[str], rows: list[list], name: str = "", align: str = "left") -> str:
    """Rows in a frame; align: left, right or center."""
    text = [[str(c) for c in r] for r in rows]
    width = [max(len(x) for x in col) for col in zip(columns, *text, strict=True)]
    place = {"left": str.ljust, "right": str.rjust, "center": str.center}[align]
    bar = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda r: "|" + "|".join(f" {place(x, w)} " for x, w in zip(r, width, strict=True)) + "|"
    head = [f"|{name.center(len(bar) - 2)}|", bar] if name else []
    return "\n".join([bar, *head, line(columns), bar, *map(line, text), bar])


def leave_one_out(model, df: DataFrame, vector: str, key: str, top_k: int = TOP_K, groups: list[str] | None = None, by_sign: bool = False, average: bool = False) -> DataFrame:
    """(key, insights): for each record the slots, or groups of slots (hashed texts, dates), whose absence moves the score most:
    array of struct(slot, difference) of the top_k by size (ties by the slots' places), or with by_sign of the top_k of each sign. A group's slots are left
    out together; with `average` one by one, and the group has the mean of its active slots.

    Every active slot gives one variant of the record; variants are scored by the model like rows, so that nothing is
    gathered but a record's own differences.
    """
    slots = df.schema[vector].metadata["slots"]
    names = groups or [s["parent"] if (s.get("descriptor") or "").startswith("hash_") else s["name"] for s in slots]
    order = {n: i for i, n in enumerate(dict.fromkeys(names))}
    group_of = F.array(*[F.lit(order[n]) for n in names])
    member = F.array(*[F.lit(i) for i in range(len(names))]) if average else group_of
    v = F.col(vector)
    active = F.array_distinct(F.transform(F.filter(F.arrays_zip(v.alias("v"), member.alias("g")), lambda x: x["v"] != 0), lambda x: x["g"]))
    rows = df.select(F.col(key), v.alias("whole"), F.explode(F.concat(F.array(F.lit(-1)), active)).alias("g"))
    without = F.zip_with("whole", member, lambda x, g: F.when(g == F.col("g"), 0.0).otherwise(x))
    scored = models.predict(model, rows.withColumn(vector, without), vector)
    m = F.col("prediction")
    score = F.coalesce(F.element_at(m, F.lit("probability_1")), F.element_at(m, F.lit("prediction")))
    whole = F.max(F.when(F.col("g") < 0, F.col("score")))
    scored = scored.select(key, "g", score.alias("score"))
    if average:
        scored = scored.withColumn("g", F.when(F.col("g") < 0, -1).otherwise(F.get(group_of, F.col("g")))).groupBy(key, "g").agg(F.avg("score").alias("score"))
    parts = scored.groupBy(key).agg(whole.alias("own"), F.collect_list(F.when(F.col("g") >= 0, F.struct("g", "score"))).alias("parts"))
    label = F.array(*[F.lit(n) for n in order])
    moved = F.transform("parts", lambda p: F.struct((F.col("own") - p["score"]).alias("d"), p["g"].alias("g"), F.get(label, p["g"]).alias("slot")))

    def best(x, sign: int):
        # what differs by less is rounding of the fit and of the scores: such slots go by their place in the vector
        size = lambda d: -F.round(F.abs(d), TIE_DIGITS)
        ordered = F.array_sort(F.transform(x, lambda e: F.struct(size(e["d"]).alias("a"), e["g"].alias("g"), e["slot"].alias("slot"), e["d"].alias("d"))))
        kept = F.filter(ordered, lambda e: e["d"] * sign > 0) if sign else ordered
        return F.transform(F.slice(kept, 1, top_k), lambda e: F.struct(e["slot"].alias("slot"), e["d"].alias("difference")))

    out = F.concat(best(moved, 1), best(moved, -1)) if by_sign else best(moved, 0)
    return parts.select(key, out.alias("insights"))


def correlation_insights(df: DataFrame, vector: str, score: str, key: str, top_k: int = TOP_K, norm: str = "znorm") -> DataFrame:
    """(key, insights): correlation of each slot with the score times the record's normalised slot value. norm: znorm, minmax
    (0 to 1) or minmax_centered (-1 to 1)."""
    from .quality import moments

    slots = df.schema[vector].metadata["slots"]
    m = moments(df, vector, score, len(slots), label_only=True)
    mean, sd, least, greatest = (x[:-1] for x in (m.mean, np.sqrt(m.variance), m.least, m.greatest))
    corr = np.nan_to_num(m.corr[-1, :-1], posinf=0.0, neginf=0.0)
    shift, scale = {"znorm": (mean, sd), "minmax": (least, greatest - least), "minmax_centered": ((least + greatest) / 2, (greatest - least) / 2)}[norm]
    scale = np.where(scale > 0, scale, np.inf)
    weights = F.array(*[F.struct(F.lit(s["name"]).alias("slot"), F.lit(float(m)).alias("m"), F.lit(float(c / k)).alias("w")) for s, m, c, k in zip(slots, shift, corr, scale, strict=True)])
    each = F.zip_with(vector, weights, lambda x, w: F.struct((-F.abs((x - w["m"]) * w["w"])).alias("a"), w["slot"].alias("slot"), ((x - w["m"]) * w["w"]).alias("d")))
    return df.select(key, F.transform(F.slice(F.array_sort(each), 1, top_k), lambda e: F.struct(e["slot"].alias("slot"), e["d"].alias("difference"))).alias("insights"))


def insights_map(c):
    """Insights as a map of slot to text, and back with parse_insights."""
    return F.map_from_entries(F.transform(c, lambda e: F.struct(e["slot"].alias("key"), e["difference"].cast("string").alias("value"))))


def parse_insights(c):
    return F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("slot"), e["value"].cast("double").alias("difference")))
