"""Scoring single records without Spark, from the manifest of a saved workflow: a dict in, a dict out.

Covers arithmetic; numbers, flags, dates, places, pivots of texts and sets, hashed texts and lists, values and pivots of maps, and
tree buckets; slot choice; linear models, naive Bayes, trees and their ensembles. Other stages are named in the error.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

import regex as re

from ..functions.text import STOP_WORDS
from ..operators.vectorizers import HASHES, MAX_HASHES

Record = dict[str, object]
_WORD = re.compile(r"[\p{L}\p{N}]+")
_MASK = (1 << 32) - 1
#: Types whose tokens are hashed here.
HASHED = {"Text", "TextArea", "TextList", "MultiPickList"}


def _finite(x: float | None) -> float | None:
    return x if x is not None and math.isfinite(x) else None


def _both(fn: Callable[[float, float], float]) -> Callable:
    def run(a, b):
        try:
            return None if a is None or b is None else _finite(fn(a, b))
        except (ZeroDivisionError, OverflowError, ValueError):
            return None

    return run


def _one(fn: Callable[[float], float]) -> Callable:
    return lambda a: _both(lambda x, _: fn(x))(a, 0.0)


def _scalar(fn: Callable[[float, float], float]) -> Callable:
    return lambda a, k: _both(fn)(a, k)


def clean(s: str | None) -> str | None:
    if s is None:
        return None
    spaced = "".join(" " if c in string.punctuation else c for c in s.lower())
    return "".join(w[:1].upper() + w[1:] for w in re.split(" +", spaced.strip(" ")))


LOCAL: dict[str, Callable] = {
    "plus": lambda a, b: b if a is None else a if b is None else a + b,
    "minus": lambda a, b: (None if b is None else -b) if a is None else a if b is None else a - b,
    "times": _both(lambda a, b: a * b),
    "divided_by": _both(lambda a, b: a / b),
    "plus_scalar": _scalar(lambda a, k: a + k),
    "minus_scalar": _scalar(lambda a, k: a - k),
    "times_scalar": _scalar(lambda a, k: a * k),
    "divided_by_scalar": _scalar(lambda a, k: a / k),
    "abs": _one(abs),
    "ceil": _one(lambda x: float(math.ceil(x))),
    "floor": _one(lambda x: float(math.floor(x))),
    "round": _one(lambda x: float(math.floor(x + 0.5))),
    "exp": _one(math.exp),
    "sqrt": _one(math.sqrt),
    "log": lambda a, base: _both(lambda x, b: math.log10(x) / math.log10(b))(a, base),
    "power": lambda a, p: _both(lambda x, y: x**y)(a, p),
    "clean": clean,
    "alias": lambda a: a,
}


def tokenize(s: str | None) -> list[str] | None:
    found = [t for t in _WORD.findall(s.lower()) if t not in STOP_WORDS] if s is not None else []
    return found or None


def murmur3(data: bytes, seed: int = 42) -> int:
    """The 32-bit MurmurHash3 that Spark ML hashes terms with, as a signed number."""

    def mixed(h: int, k: int) -> int:
        k = k * 0xCC9E2D51 & _MASK
        k = (k << 15 | k >> 17) & _MASK
        h ^= k * 0x1B873593 & _MASK
        return (h << 13 | h >> 19) & _MASK

    h, whole = seed, len(data) & ~3
    for i in range(0, whole, 4):
        h = mixed(h, int.from_bytes(data[i : i + 4], "little")) * 5 + 0xE6546B64 & _MASK
    tail = 0
    for i, x in enumerate(data[whole:]):
        tail |= x << 8 * i
    if tail or len(data) > whole:
        k = tail * 0xCC9E2D51 & _MASK
        h ^= (k << 15 | k >> 17) * 0x1B873593 & _MASK
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _MASK
    h = (h ^ h >> 13) * 0xC2B2AE35 & _MASK
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def _one_hot(values: list[str] | None, top: list[str], is_set: bool, nulls: bool) -> list[float]:
    rest = len(set(values or ()) - set(top))
    out = [float(values is not None and t in values) for t in top] + [float(rest) if is_set else float(rest > 0)]
    return out + ([float(not values)] if nulls else [])


def _pivoted(v, is_set: bool, cleaned: bool) -> list[str] | None:
    if v is None:
        return None
    return [clean(x) if cleaned else x for x in (v if is_set else [v])]


def _hashed(tokens: list[str] | None, prefix: str, size: int) -> list[float]:
    out = [0.0] * size
    for t in tokens or ():
        out[murmur3(f"{prefix}{t}".encode()) % size] += 1.0
    return out


def _buckets(x: float | None, splits: list[float], nulls: bool) -> list[float]:
    edges = [-math.inf, *splits, math.inf]
    out = [float(x is not None and a < x <= b) for a, b in zip(edges, edges[1:], strict=False)] if splits else []
    return out + ([float(x is None)] if nulls else [])


def _days(ms: int | None, reference_ms: int) -> float | None:
    return None if ms is None else float(math.trunc((reference_ms - ms) / 86_400_000))


def _encoder(e: dict, r: Record) -> list[float]:
    kind, state, options, names, out = e["kind"], e["state"], e["options"], e["names"], []
    nulls, is_set, cleaned = options.get("track_nulls", True), e["ftype"] in ("MultiPickList", "MultiPickListMap"), options.get("clean", True)

    def flag(absent: bool) -> list[float]:
        return [float(absent)] if nulls else []

    def at(n: str, k: str):
        return (r.get(n) or {}).get(k)

    if options.get("derive"):
        raise NotImplementedError(f"encoder {kind} of {names} derives its values and is not for local scoring")
    if kind in ("numeric", "binary"):
        fills = state.get("fill") or [float(options.get("fill", False))] * len(names)
        return [x for n, f in zip(names, fills, strict=True) for x in (f if r.get(n) is None else float(r[n]), *flag(r.get(n) is None))]
    if kind == "pivot":
        return [x for n in names for x in _one_hot(_pivoted(r.get(n), is_set, cleaned), state["top"][n], is_set, nulls)]
    if kind == "smart_text":
        by = {m: [n for n in names if state["method"][n] == m] for m in ("pivot", "hash", "ignore")}
        out = [x for n in by["pivot"] for x in _one_hot(_pivoted(r.get(n), False, True), state["top"][n], False, nulls)]
        if by["hash"]:
            out += _encoder(e | {"kind": "hash", "names": by["hash"], "state": {}}, r)
        return out + [x for n in by["ignore"] for x in flag(r.get(n) is None)]
    if kind == "hash" and e["ftype"] in HASHED:
        size = options.get("hashes", HASHES)
        shared = options.get("shared")
        tokens = {n: (list(r[n]) if r.get(n) is not None else None) if e["ftype"] in ("TextList", "MultiPickList") else tokenize(r.get(n)) for n in names}
        if size * len(names) > MAX_HASHES if shared is None else shared:
            out = _hashed([f"{n}_{t}" for n in names for t in tokens[n] or ()], "", size)
            return out + [x for n in names for x in flag(r.get(n) is None)]
        return [x for n in names for x in (*_hashed(tokens[n], f"{n}_", size), *flag(r.get(n) is None))]
    if kind == "days":
        return [x for n in names for x in (_days(r.get(n), options.get("reference_ms", 0)) or 0.0, *flag(r.get(n) is None))]
    if kind == "location":
        return [x for n, f in zip(names, state["fill"], strict=True) for x in (*[float(v) for v in (r[n] if r.get(n) is not None else f)], *flag(r.get(n) is None))]
    if kind == "tree":
        return [x for n in names for x in _buckets(r.get(n), state["splits"][n], nulls)]
    if kind == "map_values" and options.get("reference_ms") is None:
        return [x for n in names for k, f in zip(state["keys"][n], state["fill"][n], strict=True) for x in (f if at(n, k) is None else float(at(n, k)), *flag(at(n, k) is None))]
    if kind == "map_pivot":
        return [x for n in names for k in state["keys"][n] for x in _one_hot(_pivoted(at(n, k), is_set, cleaned), state["top"][n][k], is_set, nulls)]
    raise NotImplementedError(f"encoder {kind} of {names} is not for local scoring")


def _nodes(node) -> tuple:
    """A tree of Spark as nested tuples: (feature, threshold or the categories that go left, left, right), leaves as (value, counts)."""
    if not hasattr(node, "split") or node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction()), [float(x) for x in node.impurityStats().stats()]
    split = node.split()
    where = float(split.threshold()) if split.getClass().getSimpleName() == "ContinuousSplit" else frozenset(float(x) for x in split.leftCategories())
    return int(split.featureIndex()), where, _nodes(node.leftChild()), _nodes(node.rightChild())


def _leaf(node: tuple, x: list[float]) -> tuple:
    while len(node) == 4:
        feature, where, left, right = node
        node = left if (x[feature] in where if isinstance(where, frozenset) else x[feature] <= where) else right
    return node


def _scores(raw: list[float] | None, probability: list[float] | None, prediction: float) -> dict:
    out = {"prediction": float(prediction)}
    out |= {f"rawPrediction_{i}": float(v) for i, v in enumerate(raw or ())}
    return out | {f"probability_{i}": float(v) for i, v in enumerate(probability or ())}


def _argmax(x: list[float]) -> int:
    return max(range(len(x)), key=lambda i: (x[i], -i))


def _softmax(x: list[float]) -> list[float]:
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


class LocalScorer:
    """A function of one record, made from a fitted workflow."""

    def __init__(self, model):
        self.key, self.results = model.key, model.results
        self.steps = [(s.name, self._step(s)) for layer in model.stages for s in layer]

    def _step(self, s) -> Callable[[Record], object]:
        if s.operator in LOCAL:
            return lambda r: LOCAL[s.operator](*[r.get(n) for n in s.inputs], **s.params)
        if s.operator in ("auto_encode", "vectorize"):
            return lambda r: [x for e in s.state["encoders"] for x in _encoder(e, r)]
        if s.operator == "combine":
            return lambda r: [x for n in s.inputs for x in r[n]]
        if s.operator in ("sanity_check", "filter_min_variance"):
            return lambda r: [r[s.inputs[-1]][i] for i in s.state["keep"]]
        if s.operator == "fill_missing_with_mean":
            return lambda r: s.state["mean"] if r.get(s.inputs[0]) is None else float(r[s.inputs[0]])
        if s.operator == "z_normalize":
            return lambda r: (r[s.inputs[0]] - s.state["mean"]) / s.state["std"] if s.state["std"] else 0.0
        if s.operator == "select_model":
            return self._model(s.model, s.inputs[1])
        raise NotImplementedError(f"stage {s.operator} is not for local scoring")

    def _model(self, m, vector: str) -> Callable[[Record], object]:
        made = scorer_of(m)
        return lambda r: made(r[vector])

    def __call__(self, record: Record) -> Record:
        r = dict(record)
        for name, step in self.steps:
            r[name] = step(r)
        return {n: r[n] for n in self.results}


def scorer_of(m) -> Callable[[list[float]], dict]:
    """A fitted learner of Spark as a function of a vector. What it has learned is read out once; nothing of Spark is kept."""
    kind = type(m).__name__

    def dot(w, x) -> float:
        return math.fsum(a * b for a, b in zip(w, x, strict=True))

    if kind == "LogisticRegressionModel" and m.numClasses == 2:
        w, b, t = m.coefficients.toArray().tolist(), float(m.intercept), m.getThreshold()

        def logistic(x):
            z = dot(w, x) + b
            p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            return _scores([-z, z], [1 - p, p], p > t)

        return logistic
    if kind == "LogisticRegressionModel":
        rows, b = m.coefficientMatrix.toArray().tolist(), m.interceptVector.toArray().tolist()

        def multinomial(x):
            raw = [dot(w, x) + c for w, c in zip(rows, b, strict=True)]
            p = _softmax(raw)
            return _scores(raw, p, _argmax(p))

        return multinomial
    if kind == "LinearSVCModel":
        w, b, t = m.coefficients.toArray().tolist(), float(m.intercept), m.getThreshold()
        return lambda x: (lambda z: _scores([-z, z], None, z > t))(dot(w, x) + b)
    if kind == "NaiveBayesModel" and m.getModelType() in ("multinomial", "gaussian"):
        pi, theta = m.pi.toArray().tolist(), m.theta.toArray().tolist()
        sigma = m.sigma.toArray().tolist() if m.getModelType() == "gaussian" else None

        def bayes(x):
            if sigma is None:
                raw = [c + dot(w, x) for c, w in zip(pi, theta, strict=True)]
            else:
                raw = [c - math.fsum((v - a) ** 2 / s + math.log(s) for v, a, s in zip(x, w, q, strict=True)) / 2 for c, w, q in zip(pi, theta, sigma, strict=True)]
            p = _softmax(raw)
            return _scores(raw, p, _argmax(p))

        return bayes
    if kind == "LinearRegressionModel":
        w, b = m.coefficients.toArray().tolist(), float(m.intercept)
        return lambda x: {"prediction": dot(w, x) + b}
    if kind == "GeneralizedLinearRegressionModel":
        link = m.getLink() if m.isDefined(m.link) else {"gaussian": "identity", "poisson": "log", "binomial": "logit", "gamma": "inverse"}[m.getFamily()]
        mean = {"identity": lambda z: z, "log": math.exp, "logit": lambda z: 1 / (1 + math.exp(-z)), "inverse": lambda z: 1 / z, "sqrt": lambda z: z * z}[link]
        w, b = m.coefficients.toArray().tolist(), float(m.intercept)
        return lambda x: {"prediction": mean(dot(w, x) + b)}
    if kind.startswith(("DecisionTree", "RandomForest", "GBT")):
        trees = [_nodes(t._java_obj.rootNode()) for t in ([m] if kind.startswith("DecisionTree") else m.trees)]
        weights = [1.0] if kind.startswith("DecisionTree") else [float(w) for w in m.treeWeights]
        if kind == "GBTClassificationModel":

            def boosted(x):
                z = math.fsum(w * _leaf(t, x)[0] for w, t in zip(weights, trees, strict=True))
                p = 1 / (1 + math.exp(2 * z)) if z < 350 else 0.0
                return _scores([-z, z], [p, 1 - p], z > 0)

            return boosted
        if kind == "DecisionTreeClassificationModel":

            def tree(x):
                counts = _leaf(trees[0], x)[1]
                p = [c / sum(counts) for c in counts]
                return _scores(counts, p, _argmax(p))

            return tree
        if kind == "RandomForestClassificationModel":

            def forest(x):
                votes = [0.0] * m_classes
                for w, t in zip(weights, trees, strict=True):
                    counts = _leaf(t, x)[1]
                    for i, c in enumerate(counts):
                        votes[i] += c / sum(counts) * w
                p = [v / sum(votes) for v in votes]
                return _scores(votes, p, _argmax(p))

            m_classes = int(m.numClasses)
            return forest
        total = sum(weights) if kind.startswith("RandomForest") else 1.0
        return lambda x: {"prediction": math.fsum(w * _leaf(t, x)[0] for w, t in zip(weights, trees, strict=True)) / total}
    raise NotImplementedError(f"model {kind} is not for local scoring")
