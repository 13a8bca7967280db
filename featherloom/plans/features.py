"""Typed features as a lazy graph: raw columns, operators on them, and workflows that fit and apply the graph layer by layer.

A stage names an operator of OPERATORS and keeps its parameters and what it has learned as JSON, so that a fitted graph is saved
as one manifest (and the saved models of learners) and works on batch and streaming frames. Stages of a layer that are plain
columns go into one select.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from dataclasses import replace as with_changes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collections as K
from ..functions import dates, math, net, text
from ..operators import scalers
from ..operators import vectorizers as V
from ..types import TYPES, infer
from . import drift, insights, models, quality


@dataclass(frozen=True)
class Operator:
    """A column operator: column(*inputs, **params, state=…) gives the output column; fit(df, *input names, **params) what it learns."""

    out: str | None  # type of the output; None: that of the first input
    column: Callable | None = None
    fit: Callable | None = None
    frame: Callable | None = None  # of (df, names, params, state, out) for operators that are no columns


OPERATORS: dict[str, Operator] = {}


def _plain(name: str, out: str | None, fn: Callable) -> None:
    OPERATORS[name] = Operator(out, lambda *c, state=None, **p: fn(*c, **p))


for _name, _fn in (("plus", math.add), ("minus", math.subtract), ("times", math.multiply), ("divided_by", math.divide), ("plus_scalar", math.add_scalar), ("minus_scalar", math.subtract_scalar), ("times_scalar", math.multiply_scalar), ("divided_by_scalar", math.divide_scalar), ("abs", math.absolute), ("exp", math.exp), ("sqrt", math.sqrt), ("log", math.log), ("power", math.power), ("round_digits", math.round_digits), ("scale_linear", math.scale_linear), ("descale_linear", math.descale_linear), ("scale_log", math.scale_log), ("descale_log", math.descale_log)):
    _plain(_name, "Real", _fn)
for _name, _fn in (("ceil", math.ceil), ("floor", math.floor), ("round", math.round_half_up)):
    _plain(_name, "Integral", _fn)
_plain("bucketize", "OPVector", math.bucketize)
_plain("clean", None, text.clean)
for _name, _fn in (("tokenize", text.tokenize), ("tokenize_html", text.tokenize_html), ("tokenize_regex", text.tokenize_regex), ("sentences", text.sentences), ("ngrams", text.ngrams), ("remove_stop_words", text.remove_stop_words)):
    _plain(_name, "TextList", _fn)
_plain("is_substring", "Binary", text.is_substring)
_plain("jaccard_similarity", "RealNN", text.jaccard)
_plain("ngram_similarity", "RealNN", text.ngram_similarity)
_plain("set_ngram_similarity", "RealNN", text.set_ngram_similarity)
_plain("token_length", "RealNN", text.token_length)
_plain("to_multi_pick_list", "MultiPickList", lambda c: F.when(c.isNotNull(), F.array(c)))
for _name, _out, _fn in (
    ("email_prefix", "Text", net.email_prefix), ("email_domain", "PickList", net.email_domain), ("is_valid_email", "Binary", net.is_valid_email), ("url_domain", "PickList", net.url_domain),
    ("url_protocol", "PickList", net.url_protocol), ("is_valid_url", "Binary", net.url_is_valid), ("parse_phone", "Phone", net.parse_phone), ("is_valid_phone", "Binary", net.is_valid_phone),
    ("phone_map_valid", "BinaryMap", net.phone_map_valid), ("email_map_domains", "PickListMap", net.email_map_domains), ("url_map_domains", "PickListMap", net.url_map_domains),
    ("mime_type", "PickList", net.mime_type), ("mime_types", "PickListMap", net.mime_types), ("base64_text", "Text", net.base64_text),
    ("time_period", "Integral", lambda c, period: dates.time_period(c, period).cast("long")), ("time_period_list", "OPVector", dates.time_period_list), ("time_period_map", "IntegralMap", dates.time_period_map),
    ("unit_circle", "OPVector", dates.unit_circle), ("to_date_list", "DateList", dates.to_date_list), ("date_list_pivot", "OPVector", dates.date_list_pivot),
    ("filter_map", None, K.filter_map), ("occurs", "RealNN", K.occurs), ("replace_with", None, K.replace_value), ("top_n_map", "RealMap", K.top_n_map), ("dot", "Real", K.vector_dot), ("combine_vectors", "OPVector", K.combine),
    ("alias", None, lambda c: c), ("gender_by_honorific", "PickList", text.gender_by_honorific), ("name_share", "RealNN", text.name_share),
):
    _plain(_name, _out, _fn)


def _learned(name: str, out: str, fit: Callable, column: Callable) -> None:
    OPERATORS[name] = Operator(out, lambda *c, state=None, **p: column(*c, state, **p), lambda df, *n, **p: fit(df, *[F.col(f"`{x}`") for x in n], **p))


_learned("fill_missing_with_mean", "RealNN", lambda df, c, default=0.0: {"mean": scalers.fit_mean(df, c, default)}, lambda c, s, default=0.0: scalers.fill(c, s["mean"]))
_learned("z_normalize", "RealNN", scalers.fit_standard, scalers.standardise)
_learned("to_percentile", "RealNN", lambda df, c, buckets=100: {"edges": scalers.fit_percentiles(df, c, buckets)}, lambda c, s, buckets=100: scalers.percentile(c, s["edges"], buckets))
_learned("to_isotonic_calibrated", "RealNN", scalers.fit_isotonic, lambda score, label, s: scalers.calibrate(score, s))
_learned("indexed", "RealNN", lambda df, c, unseen="keep": {"labels": scalers.fit_labels(df, c)}, lambda c, s, unseen="keep": scalers.index_labels(c, s["labels"], unseen))
_learned("deindexed", "Text", lambda df, c, labels=None: {"labels": labels}, lambda c, s, labels=None: scalers.label_at(c, s["labels"]))


def _fit_auto_encode(df: DataFrame, *names: str, label: str | None = None, **options) -> dict:
    typed = df.select(*[F.col(f"`{n}`") for n in (*names, *([label] if label else []))])
    return {"encoders": [e.to_json() for e in V.auto_encode(typed, list(names), label=label, **options)]}


def _apply_encoders(df: DataFrame, names: list[str], params: dict, state: dict, out: str) -> DataFrame:
    return V.encode(df, [V.Encoder(**e) for e in state["encoders"]], out)


def _fit_vectorize(df: DataFrame, *names: str, kind: str, ftype: str, **options) -> dict:
    return {"encoders": [V.fit(df, kind, list(names), ftype, **options).to_json()]}


def _fit_check(df: DataFrame, label: str, vector: str, **params) -> dict:
    found, keep = quality.sanity_check(df, vector, label, quality.CheckParams(**params))
    return {"keep": keep, "statistics": [s.__dict__ for s in found]}


OPERATORS["auto_encode"] = Operator("OPVector", fit=_fit_auto_encode, frame=_apply_encoders)
OPERATORS["vectorize"] = Operator("OPVector", fit=_fit_vectorize, frame=_apply_encoders)
OPERATORS["combine"] = Operator("OPVector", frame=lambda df, names, p, s, out: V.combine(df, names, out))
OPERATORS["sanity_check"] = Operator("OPVector", fit=_fit_check, frame=lambda df, names, p, s, out: V.keep_slots(df, s["keep"], names[1], out))
OPERATORS["filter_min_variance"] = Operator("OPVector", fit=lambda df, v, least=1e-5: {"keep": quality.vary_enough(df, v, least)}, frame=lambda df, names, p, s, out: V.keep_slots(df, s["keep"], names[0], out))

#: Spark ML stages by a short name: class, input parameter, whether the input and the output are vectors.
ML_STAGES = {
    "tf": ("pyspark.ml.feature.HashingTF", False, True),
    "idf": ("pyspark.ml.feature.IDF", True, True),
    "count_vec": ("pyspark.ml.feature.CountVectorizer", False, True),
    "word2vec": ("pyspark.ml.feature.Word2Vec", False, True),
    "lda": ("pyspark.ml.clustering.LDA", True, True),
    "ml_ngram": ("pyspark.ml.feature.NGram", False, False),
    "ml_stop_words": ("pyspark.ml.feature.StopWordsRemover", False, False),
    "string_index": ("pyspark.ml.feature.StringIndexer", False, False),
}


def ml_stage(name: str, params: dict):
    """A Spark ML stage, its input and output columns named as the wrappers expect."""
    from importlib import import_module

    module, _, cls = ML_STAGES[name][0].rpartition(".")
    kind = getattr(import_module(module), cls)
    ends = {"featuresCol": "__in", "topicDistributionCol": "__out"} if name == "lda" else {"inputCol": "__in", "outputCol": "__out"}
    return kind(**ends, **params)


#: Before the names of vectors that Spark ML has made, as it has made them: often sparse, where the arrays hold all slots.
SPARSE = "__sparse_"


def ml_input(df: DataFrame, name: str, source: str) -> Column:
    """What a stage takes. An absent list counts as an empty one; a vector that another stage has made is taken as it was made."""
    from pyspark.ml.functions import array_to_vector

    c = F.col(f"`{source}`")
    if ML_STAGES[name][1]:
        return F.col(f"`{SPARSE}{source}`") if SPARSE + source in df.columns else array_to_vector(c)
    return F.coalesce(c, F.array().cast("array<string>")) if dict(df.dtypes)[source].startswith("array") else c


def spread(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df in tasks of so many rows at most, for fits that keep what they read: files that compress well are read by few tasks."""
    parts = -(-df.count() // rows)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism)) if parts > 1 else df


def ml_transform(model, name: str, df: DataFrame, source: str, out: str) -> DataFrame:
    """df with the stage's output; vectors are arrays of doubles outside, and vectors for the stages after it."""
    from pyspark.ml.functions import vector_to_array

    made = model.transform(df.withColumn("__in", ml_input(df, name, source)))
    if ML_STAGES[name][2]:
        made = made.withColumn(SPARSE + out, F.col("__out")).withColumn(out, vector_to_array("__out"))
    else:
        made = made.withColumn(out, F.col("__out"))
    return made.drop("__in", "__out")


def stored_values(name: str) -> Column:
    """The values that a vector of a Spark ML stage stores, on a frame made with sparse=True: all but zeros where it is sparse."""
    return F.unwrap_udt(F.col(f"`{SPARSE}{name}`"))["values"]


for _name, (_, _, _vector) in ML_STAGES.items():
    OPERATORS[_name] = Operator("OPVector" if _vector else "RealNN" if _name == "string_index" else "TextList")
_plain("detect_languages", "RealMap", text.detect_languages)
_plain("recognize_entities", "MultiPickListMap", text.recognize_entities)
_plain("tokenize_language", "TextList", text.tokenize_language)
_plain("stem", "TextList", text.stem)

#: Functions of one's own by name, for the `map` operator.
FUNCTIONS: dict[str, Callable[..., Column]] = {}
OPERATORS["map"] = Operator("Real", lambda *c, state=None, function, ftype="Real": FUNCTIONS[function](*c))


@dataclass(frozen=True, eq=False)
class Feature:
    """A column to be: a raw one, or the output of an operator."""

    name: str
    ftype: str
    operator: str | None = None
    inputs: tuple[Feature, ...] = ()
    params: dict = field(default_factory=dict)
    response: bool = False

    def apply(self, operator: str, *others: Feature, name: str | None = None, **params) -> Feature:
        inputs = (self, *others)
        made = name or f"{'-'.join(f.name for f in inputs)}_{operator}" + (f"_{_digest(params)}" if params else "")
        made = made if len(made) <= 80 else f"{made[:70]}_{_digest({'name': made})}"
        return Feature(made, OPERATORS[operator].out or self.ftype, operator, inputs, params, any(f.response for f in inputs) and operator not in LABEL_AWARE)

    def __getattr__(self, name: str):
        if name.startswith("__") or name not in OPERATORS:
            raise AttributeError(name)
        return lambda *others, **params: self.apply(name, *others, **params)

    def _arith(self, other, operator: str) -> Feature:
        return self.apply(operator, other) if isinstance(other, Feature) else self.apply(f"{operator}_scalar", k=float(other))

    def __add__(self, other) -> Feature:
        return self._arith(other, "plus")

    def __sub__(self, other) -> Feature:
        return self._arith(other, "minus")

    def __mul__(self, other) -> Feature:
        return self._arith(other, "times")

    def __truediv__(self, other) -> Feature:
        return self._arith(other, "divided_by")

    def map(self, function: Callable[..., Column], *others: Feature, ftype: str = "Real", name: str | None = None) -> Feature:
        """A column function of one's own over one or more features, found again by its name when loaded."""
        FUNCTIONS[function.__name__] = function
        return with_changes(self.apply("map", *others, name=name, function=function.__name__, ftype=ftype), ftype=ftype)

    def vectorize(self, kind: str | None = None, **options) -> Feature:
        kinds = V.default_encoders(self.ftype, options.pop("reference_ms", 0), {}, options.pop("hashes", V.HASHES))
        found = dict(kinds).get(kind, {}) if kind else kinds[0][1]
        return self.apply("vectorize", kind=kind or kinds[0][0], ftype=self.ftype, **found, **options)

    def pivot(self, **options) -> Feature:
        return self.vectorize("pivot", **options)

    def auto_bucketize(self, label: Feature, **options) -> Feature:
        """Tree buckets against a label. The label is read from the training data and is no input when scoring."""
        return self.apply("vectorize", kind="map_tree" if self.ftype.endswith("Map") else "tree", ftype=self.ftype, label=label.name, **options)

    def tfidf(self, terms: int = V.HASHES, min_documents: int = 0, binary: bool = False, name: str | None = None) -> Feature:
        return self.apply("tf", numFeatures=terms, binary=binary).apply("idf", name=name, minDocFreq=min_documents)

    def ancestors(self) -> list[Feature]:
        """All features that this one comes from, itself last; a cycle cannot be made."""
        seen: dict[int, Feature] = {}

        def visit(f: Feature) -> None:
            if id(f) not in seen:
                for x in f.inputs:
                    visit(x)
                seen[id(f)] = f

        visit(self)
        return list(seen.values())


#: Their outputs are predictors although an input is a response.
LABEL_AWARE = {"sanity_check", "vectorize", "auto_encode", "to_isotonic_calibrated", "select_model"}


def _digest(params: dict) -> str:
    import hashlib

    return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:8]


def raw(name: str, ftype: str, response: bool = False) -> Feature:
    return Feature(name, ftype, response=response)


def from_schema(df: DataFrame, response: str) -> tuple[Feature, list[Feature]]:
    """The response and the predictors that the columns of a frame suggest."""
    names = df.columns
    if names.count(response) != 1:
        raise ValueError(f"{response} must be one column of {names}")
    if TYPES[infer(df.schema[response])].family not in ("real", "integral", "binary"):
        raise TypeError(f"the response {response} is not numeric")
    return raw(response, "RealNN", True), [raw(f.name, infer(f)) for f in df.schema.fields if f.name != response]


def auto_encode(features: list[Feature], label: Feature | None = None, name: str = "features", **options) -> Feature:
    """Default encoding of the features into one vector."""
    extra = {"label": label.name} if label else {}
    return features[0].apply("auto_encode", *features[1:], name=name, **extra, **options)


def sanity_check(label: Feature, vector: Feature, name: str = "checked", **params) -> Feature:
    return label.apply("sanity_check", vector, name=name, **params)


def select_model(label: Feature, vector: Feature, selector: models.Selector, name: str = "prediction") -> Feature:
    return Feature(name, "Prediction", "select_model", (label, vector), {"selector": selector})


def layers(results: list[Feature]) -> list[list[Feature]]:
    """Derived features by their distance from raw ones; a stage that is reached twice stands once."""
    depth: dict[str, int] = {}
    known: dict[str, Feature] = {}
    for r in results:
        for f in r.ancestors():
            own = 1 + max((depth[x.name] for x in f.inputs), default=-1)
            if f.name in known and known[f.name] is not f and (known[f.name].operator, known[f.name].params) != (f.operator, f.params):
                raise ValueError(f"two different features are named {f.name}")
            known.setdefault(f.name, f)
            depth[f.name] = max(own, depth.get(f.name, 0))
    out: dict[int, list[Feature]] = {}
    for n, f in known.items():
        if f.operator:
            out.setdefault(depth[n], []).append(f)
    return [out[d] for d in sorted(out)]


def raw_features(results: list[Feature]) -> list[Feature]:
    return list({f.name: f for r in results for f in r.ancestors() if not f.operator}.values())


@dataclass
class Fitted:
    """A stage ready to apply."""

    name: str
    ftype: str
    operator: str
    inputs: list[str]
    params: dict
    state: dict
    model: object = None

    def is_column(self) -> bool:
        return self.operator != "select_model" and OPERATORS[self.operator].column is not None

    def column(self) -> Column:
        inputs = [F.col(f"`{n}`") for n in self.inputs]
        made = OPERATORS[self.operator].column(*inputs, state=self.state, **self.params)
        return made.alias(self.name, metadata={"ftype": self.ftype})

    def frame(self, df: DataFrame) -> DataFrame:
        if self.operator == "select_model":
            return models.predict(self.model, df, self.inputs[1], self.name)
        if self.operator in ML_STAGES:
            return ml_transform(self.model, self.operator, df, self.inputs[0], self.name)
        return OPERATORS[self.operator].frame(df, self.inputs, self.params, self.state, self.name)


def apply_layer(df: DataFrame, stages: list[Fitted]) -> DataFrame:
    """The columns of a layer in one select, then the stages that need a frame."""
    columns = [s.column() for s in stages if s.is_column()]
    if columns:
        df = df.select("*", *columns)
    for s in stages:
        if not s.is_column():
            df = s.frame(df)
    return df


class Workflow:
    """Features to make, a key, and how raw features are filtered; train() fits the graph on a frame of raw features."""

    def __init__(self, results: list[Feature], key: str = "key", filter_params: drift.FilterParams | None = None, scoring: DataFrame | None = None, reuse: WorkflowModel | None = None):
        self.results, self.key, self.filter_params, self.scoring = results, key, filter_params, scoring
        self.known = {s.name: s for layer in reuse.stages for s in layer} if reuse else {}

    def train(self, df: DataFrame) -> WorkflowModel:
        """Fit all stages, layer by layer; stages of a model to reuse are taken as they are."""
        found = raw_features(self.results)
        df = df.select(F.col(self.key), *[F.col(f.name).alias(f.name, metadata={"ftype": f.ftype}) for f in found if f.name != self.key])
        blocked: list[str] = []
        verdicts: list = []
        bad_keys: dict[str, list[str]] = {}
        if self.filter_params:
            predictors = [f.name for f in found if not f.response]
            labels = [f.name for f in found if f.response and TYPES[f.ftype].family in ("real", "integral", "binary")]
            df, blocked, bad_keys, verdicts = drift.filter_raw(df, predictors, labels, self.scoring, self.filter_params)
        results = [r for r in (without(r, set(blocked)) for r in self.results) if r is not None]
        if not results:
            raise ValueError("the raw-feature filter left nothing of the results")
        out: list[list[Fitted]] = []
        for layer in layers(results):
            stages = [self.known.get(f.name) or self.fit(f, df) for f in layer]
            df = apply_layer(df, stages)
            out.append(stages)
        return WorkflowModel(out, [r.name for r in results], {f.name: f.ftype for f in found if f.name not in blocked}, [f.name for f in found if f.response], self.key, {"blocked": blocked, "keys": bad_keys, "verdicts": [v.__dict__ for v in verdicts]})

    def fit(self, f: Feature, df: DataFrame) -> Fitted:
        names = [x.name for x in f.inputs]
        if f.operator == "select_model":
            chosen = f.params["selector"].fit(df, names[1], names[0], F.col(self.key))
            slots = df.schema[names[1]].metadata.get("slots", [])
            state = {"insights": insights.model_insights(chosen, slots), "slots": slots}
            return Fitted(f.name, f.ftype, f.operator, names, {}, state, chosen.model)
        if f.operator in ML_STAGES:
            stage = ml_stage(f.operator, f.params)
            c = ml_input(df, f.operator, names[0])
            rows = df.select(c.alias("__in"))
            model = stage.fit(spread(rows) if f.operator == "lda" else rows) if hasattr(stage, "fit") else stage
            return Fitted(f.name, f.ftype, f.operator, names, f.params, {}, model)
        learn = OPERATORS[f.operator].fit
        return Fitted(f.name, f.ftype, f.operator, names, f.params, learn(df, *names, **f.params) if learn else {})

    def compute_up_to(self, feature: Feature, df: DataFrame) -> DataFrame:
        """The frame with one feature and all that it needs."""
        return Workflow([feature], self.key).train(df).transform(df)


def without(f: Feature, blocked: set[str]) -> Feature | None:
    """The feature without blocked raw ones: stages over many inputs lose those, others go."""
    if f.name in blocked:
        return None
    if not f.operator:
        return f
    kept = [without(x, blocked) for x in f.inputs]
    if all(a is b for a, b in zip(kept, f.inputs, strict=True)):
        return f
    some = tuple(x for x in kept if x is not None)
    if f.operator not in ("auto_encode", "vectorize", "combine") and len(some) < len(f.inputs) or not some:
        return None
    return with_changes(f, inputs=some)


@dataclass
class WorkflowModel:
    stages: list[list[Fitted]]
    results: list[str]
    raw: dict[str, str]
    responses: list[str]
    key: str
    filtered: dict

    def transform(self, df: DataFrame, sparse: bool = False) -> DataFrame:
        """All features, on a batch or streaming frame. No action is run. A missing response is null. sparse: vectors of Spark ML
        stages stand beside their arrays, for stored_values."""
        have = set(df.columns)
        cols = [F.col(n).alias(n, metadata={"ftype": t}) if n in have or n not in self.responses else F.lit(None).cast(TYPES[t].spark).alias(n, metadata={"ftype": t}) for n, t in self.raw.items() if n != self.key]
        out = df.select(F.col(self.key), *cols)
        for n, keys in self.filtered["keys"].items():
            out = out.withColumn(n, F.map_filter(n, drift._outside(keys)))
        for layer in self.stages:
            out = apply_layer(out, layer)
        return out if sparse else out.drop(*[c for c in out.columns if c.startswith(SPARSE)])

    def score(self, df: DataFrame, keep_raw: bool = False) -> DataFrame:
        out = self.transform(df)
        return out if keep_raw else out.select(self.key, *self.results)

    def evaluate(self, df: DataFrame, metric: str) -> float:
        from . import evaluators

        stage = next(s for layer in self.stages for s in layer if s.operator == "select_model")
        scored = self.transform(df).withColumn(models.LABEL, F.col(stage.inputs[0]).cast("double"))
        return evaluators.METRICS[metric][0](models.evaluated(scored, stage.name), "y", "p", "s")

    def insights(self) -> dict:
        return next((s.state["insights"] for layer in self.stages for s in layer if s.operator == "select_model"), {})

    def summary(self) -> str:
        found = self.insights()
        return insights.pretty(found) if found else "no model"

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON manifest, written through Spark so that any file system will do, and the learners' own format beside it."""
        kinds = {}
        for layer in self.stages:
            for s in layer:
                if s.model is not None:
                    s.model.write().overwrite().save(f"{path}/{s.name}")
                    kinds[s.name] = f"{type(s.model).__module__}.{type(s.model).__name__}"
        stages = [[{k: getattr(s, k) for k in ("name", "ftype", "operator", "inputs", "params", "state")} for s in layer] for layer in self.stages]
        whole = {"stages": stages, "models": kinds} | {k: getattr(self, k) for k in ("results", "raw", "responses", "key", "filtered")}
        spark.createDataFrame([(json.dumps(whole, default=str),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> WorkflowModel:
        from importlib import import_module

        whole = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        stages = [[Fitted(**s) for s in layer] for layer in whole["stages"]]
        for layer in stages:
            for s in layer:
                if s.name in whole["models"]:
                    module, _, name = whole["models"][s.name].rpartition(".")
                    s.model = getattr(import_module(module), name).load(f"{path}/{s.name}")
        return cls(stages, *[whole[k] for k in ("results", "raw", "responses", "key", "filtered")])
