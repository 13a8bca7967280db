"""Models and their selection: Spark ML learners behind one form of prediction, grids, validation by folds, and the best refitted."""

from __future__ import annotations

import logging
import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluators, splitters

log = logging.getLogger(__name__)
VECTOR, LABEL = "__vector", "__label"
CLASSIFIERS = {
    "LogisticRegression": C.LogisticRegression,
    "RandomForestClassifier": C.RandomForestClassifier,
    "GBTClassifier": C.GBTClassifier,
    "DecisionTreeClassifier": C.DecisionTreeClassifier,
    "LinearSVC": C.LinearSVC,
    "NaiveBayes": C.NaiveBayes,
    "MultilayerPerceptronClassifier": C.MultilayerPerceptronClassifier,
}
REGRESSORS = {
    "LinearRegression": R.LinearRegression,
    "RandomForestRegressor": R.RandomForestRegressor,
    "GBTRegressor": R.GBTRegressor,
    "DecisionTreeRegressor": R.DecisionTreeRegressor,
    "GeneralizedLinearRegression": R.GeneralizedLinearRegression,
}
# The default grids.
_LINEAR = {"regParam": [0.001, 0.01, 0.1, 0.2], "elasticNetParam": [0.1, 0.5], "maxIter": [50]}
_TREES = {"maxDepth": [3, 6, 12], "minInstancesPerNode": [10, 100], "minInfoGain": [0.001, 0.01, 0.1], "maxBins": [32]}
GRIDS: dict[str, dict[str, list]] = {
    "LogisticRegression": _LINEAR,
    "LinearRegression": _LINEAR,
    "RandomForestClassifier": _TREES | {"numTrees": [50]},
    "RandomForestRegressor": _TREES | {"numTrees": [50]},
    "GBTClassifier": _TREES | {"maxIter": [20]},
    "GBTRegressor": _TREES | {"maxIter": [20]},
    "DecisionTreeClassifier": _TREES,
    "DecisionTreeRegressor": _TREES,
    "LinearSVC": {"regParam": [0.001, 0.01, 0.1, 0.2], "maxIter": [50]},
    "NaiveBayes": {"smoothing": [1.0]},
    "MultilayerPerceptronClassifier": {"maxIter": [100]},
    "GeneralizedLinearRegression": {"family": ["gaussian", "poisson"], "regParam": [0.001, 0.01, 0.1, 0.2]},
}


def estimator(name: str, params: dict | None = None):
    """An untrained learner. Gradient-boosted trees of another library are used for `XGBoost…` where it can be imported, Spark's
    own otherwise."""
    if name.startswith("XGBoost"):
        try:
            import xgboost.spark as X

            made = (X.SparkXGBClassifier if "Class" in name else X.SparkXGBRegressor)(features_col=VECTOR, label_col=LABEL)
            return made.copy({made.getParam(k): v for k, v in (params or {}).items()})
        except ImportError:
            name = "GBTClassifier" if "Class" in name else "GBTRegressor"
    kind = (CLASSIFIERS | REGRESSORS)[name]
    return kind(featuresCol=VECTOR, labelCol=LABEL, **(params or {}))


def fit(name: str, params: dict | None, df: DataFrame):
    """A learner fitted to a frame made ready. The model is kept without its training summary: that holds the session, which cannot
    be sent to tasks once an observation or a stream has been used in it, and the functions that score take the model with them."""
    model = estimator(name, params).fit(df)
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(df.sparkSession._jvm.scala.Option.empty())
    return model


def grid(name: str, options: dict[str, list] | None = None) -> list[dict]:
    out: list[dict] = [{}]
    for k, values in (GRIDS.get(name, {}) if options is None else options).items():
        out = [g | {k: v} for g in out for v in values]
    return out


class RandomParams:
    """Random grids: uniform, log-uniform, and choice of a subset."""

    def __init__(self, seed: int = splitters.SEED):
        self.random = random.Random(seed)
        self.draws: dict[str, object] = {}

    def uniform(self, name: str, lo: float, hi: float) -> RandomParams:
        whole = isinstance(lo, int) and isinstance(hi, int)
        self.draws[name] = lambda: self.random.randint(lo, hi) if whole else self.random.uniform(lo, hi)
        return self

    def exponential(self, name: str, lo: float, hi: float) -> RandomParams:
        if lo <= 0:
            raise ValueError("a log-uniform range is positive")
        self.draws[name] = lambda: math.exp(self.random.uniform(math.log(lo), math.log(hi)))
        return self

    def subset(self, name: str, values: list) -> RandomParams:
        self.draws[name] = lambda: self.random.choice(values)
        return self

    def build(self, n: int) -> list[dict]:
        return [{k: f() for k, f in self.draws.items()} for _ in range(n)]


def ready(df: DataFrame, vector: str, label: str | None) -> DataFrame:
    """df with the vector, and the label if given, in the form that learners take."""
    out = df.withColumn(VECTOR, array_to_vector(F.col(vector)))
    return out.withColumn(LABEL, F.col(label).cast("double")) if label else out


def predict(model, df: DataFrame, vector: str, out: str = "prediction") -> DataFrame:
    """df with `out`: a map with prediction, and rawPrediction_i and probability_i where the model gives them."""
    made = model.transform(ready(df, vector, None))
    return made.withColumn(out, prediction_map(made)).select(*[c for c in df.columns if c != out], out)


def prediction_map(df: DataFrame) -> Column:
    entries = F.array(F.struct(F.lit("prediction").alias("key"), F.col("prediction").cast("double").alias("value")))
    for kind in ("rawPrediction", "probability"):
        if kind in df.columns:
            entries = F.concat(entries, F.transform(vector_to_array(kind), _named(kind)))
    return F.map_from_entries(entries)


def _named(kind: str):
    return lambda v, i: F.struct(F.concat(F.lit(f"{kind}_"), i.cast("string")).alias("key"), v.alias("value"))


def evaluated(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Columns y, p and s (score of class 1; the prediction where there are no probabilities) of scored rows."""
    m = F.col(prediction)
    s = F.coalesce(F.element_at(m, F.lit("probability_1")), F.element_at(m, F.lit("rawPrediction_1")), F.element_at(m, F.lit("prediction")))
    return df.select(F.col(LABEL).alias("y"), F.element_at(m, F.lit("prediction")).alias("p"), s.alias("s"))


def measure(metric: str, model, df: DataFrame) -> float:
    """A metric of a model on a frame made ready. Scores are taken from the model's columns: a map of them for each row costs more
    than the model."""
    made = model.transform(df)
    s = [F.get(vector_to_array(c), F.lit(1)) for c in ("probability", "rawPrediction") if c in made.columns]
    p = F.col("prediction").cast("double")
    return evaluators.METRICS[metric][0](made.select(F.col(LABEL).alias("y"), p.alias("p"), F.coalesce(*s, p).alias("s")), "y", "p", "s")


@dataclass
class Trial:
    model: str
    params: dict
    scores: list[float] = field(default_factory=list)

    @property
    def score(self) -> float:
        return sum(self.scores) / len(self.scores)


@dataclass(frozen=True)
class Validation:
    """k folds, or with folds=1 one split that trains on `ratio`. stratified: folds are dealt within each label."""

    folds: int = 3
    ratio: float = 0.75
    stratified: bool = False
    parallelism: int = 8
    seed: int = splitters.SEED

    def parts(self, df: DataFrame, key: Column) -> list[tuple[DataFrame, DataFrame]]:
        k = F.concat_ws("#", F.col(LABEL).cast("string"), key.cast("string")) if self.stratified else key
        seed = splitters.apart(self.seed, "folds")
        if self.folds > 1:
            dealt = splitters.folds(df, k, self.folds, seed)
            return [(dealt.where(F.col("fold") != i), dealt.where(F.col("fold") == i)) for i in range(self.folds)]
        u = splitters.unit_hash(k, seed)
        return [(df.where(u < self.ratio), df.where(u >= self.ratio))]


def validate(df: DataFrame, vector: str, key: Column, candidates: list[tuple[str, list[dict]]], metric: str, how: Validation = Validation()) -> list[Trial]:
    """The trials that finished all folds, best first. Fits run side by side; one that fails there is tried once more alone, since
    plans that several threads share can fail for each other's sake. One that fails again is logged and left out, and if none
    is left that is an error."""
    trials = [Trial(name, params) for name, grids in candidates for params in grids]
    parts = how.parts(df, key)

    def run(job: tuple[Trial, int]) -> tuple[tuple[Trial, int], float | None, Exception | None]:
        trial, i = job
        try:
            model = fit(trial.model, trial.params, parts[i][0])
            return job, measure(metric, model, parts[i][1]), None
        except Exception as e:  # noqa: BLE001 - a grid point that cannot be fitted is left out
            log.warning("%s %s failed", trial.model, trial.params, exc_info=True)
            return job, None, e

    with ThreadPoolExecutor(how.parallelism) as pool:
        found = list(pool.map(run, [(t, i) for t in trials for i in range(len(parts))]))
    found = [run(job) if error is not None else (job, score, error) for job, score, error in found]
    failures = [error for _, _, error in found if error is not None]
    for (trial, _), score, _ in found:
        if score is not None and not math.isnan(score):
            trial.scores.append(score)
    done = [t for t in trials if len(t.scores) == len(parts)]
    if not done:
        raise RuntimeError(f"no candidate could be fitted; {len(failures)} fits failed, the first by: {str(failures[0])[:500] if failures else 'no score'}") from (failures or [None])[0]
    return sorted(done, key=lambda t: -t.score if evaluators.METRICS[metric][1] else t.score)


@dataclass(frozen=True)
class Selector:
    """Candidates, metric, validation and preparation of a kind of problem."""

    candidates: list[tuple[str, list[dict]]]
    metric: str
    splitter: object = field(default_factory=splitters.DataSplitter)
    validation: Validation = field(default_factory=Validation)

    def fit(self, df: DataFrame, vector: str, label: str, key: Column) -> Selected:
        data = ready(df, vector, label).where(F.col(LABEL).isNotNull()).withColumn("__key", key.cast("string"))
        held = getattr(self.splitter, "reserve", 0.1)
        train, test = splitters.hold_out(data, F.col("__key"), held, splitters.apart(self.validation.seed, "test"))
        prepared, summary = self.splitter.prepare(train, F.col("__key"), LABEL)
        prepared = prepared.cache()
        try:
            trials = validate(prepared, vector, F.col("__key"), self.candidates, self.metric, self.validation)
            best = fit(trials[0].model, trials[0].params, prepared)
            on = lambda d: measure(self.metric, best, d)
            return Selected(best, trials[0].model, trials[0].params, self.metric, trials[0].score, on(prepared), on(test), [(t.model, t.params, t.score) for t in trials], summary)
        finally:
            prepared.unpersist()


@dataclass
class Selected:
    """The model that won, refitted on all prepared rows."""

    model: object
    name: str
    params: dict
    metric: str
    validation_score: float
    train_score: float
    holdout_score: float
    trials: list[tuple]
    preparation: dict

    def transform(self, df: DataFrame, vector: str, out: str = "prediction") -> DataFrame:
        return predict(self.model, df, vector, out)


def _candidates(names: list[str], grids: dict | None) -> list[tuple[str, list[dict]]]:
    return [(n, grid(n, (grids or {}).get(n))) for n in names]


def binary_selector(models: list[str] | None = None, grids: dict | None = None, metric: str = "au_pr", splitter=None, **validation) -> Selector:
    names = models or ["LogisticRegression", "RandomForestClassifier", "XGBoostClassifier"]
    return Selector(_candidates(names, grids), metric, splitter or splitters.DataBalancer(), Validation(**validation))


def multi_selector(models: list[str] | None = None, grids: dict | None = None, metric: str = "error", splitter=None, **validation) -> Selector:
    return Selector(_candidates(models or ["LogisticRegression", "RandomForestClassifier"], grids), metric, splitter or splitters.DataCutter(), Validation(**validation))


def regression_selector(models: list[str] | None = None, grids: dict | None = None, metric: str = "rmse", splitter=None, **validation) -> Selector:
    return Selector(_candidates(models or ["LinearRegression", "RandomForestRegressor", "GBTRegressor"], grids), metric, splitter or splitters.DataSplitter(), Validation(**validation))


def combine(df: DataFrame, first: str, second: str, weights: tuple[float, float] | None = None, out: str = "prediction", classes: int = 2) -> DataFrame:
    """Two predictions mixed by weight (equal if none is given; (1, 0) takes the first): the class of the greatest mixed
    probability, or for regressions the mixed prediction."""
    a, b = weights or (0.5, 0.5)
    a, b = a / (a + b), b / (a + b)
    get = lambda c, k: F.element_at(F.col(c), F.lit(k))
    mixed = F.array(*[get(first, f"probability_{i}") * a + get(second, f"probability_{i}") * b for i in range(classes)])
    at = F.when(get(first, "probability_0").isNotNull(), (F.array_position(mixed, F.array_max(mixed)) - 1).cast("double")).otherwise(get(first, "prediction") * a + get(second, "prediction") * b)
    entries = F.array(F.struct(F.lit("prediction").alias("key"), at.alias("value")))
    probs = F.filter(F.transform(mixed, _named("probability")), lambda e: e["value"].isNotNull())
    return df.withColumn(out, F.map_from_entries(F.concat(entries, probs)))
