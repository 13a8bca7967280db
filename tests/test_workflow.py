"""Feature graphs, encoders, models, drift, streaming and runs end to end, on small tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from featherloom.operators import scalers
from featherloom.operators import vectorizers as V
from featherloom.plans import drift, evaluators, insights, models, quality, splitters
from featherloom.plans import features as G
from featherloom.plans.local import LocalScorer
from featherloom.plans.runner import Runner, RunParams, generate_project, main


@pytest.fixture(scope="module")
def people(spark):
    rows = [(str(i), float(i % 2), float(i) if i % 5 else None, ["red", "blue", None][i % 3]) for i in range(120)]
    return spark.createDataFrame([(k, y, x if x is None else x + 200 * y, c) for k, y, x, c in rows], "key string, label double, x double, colour string")


@pytest.fixture(scope="module")
def graph():
    label, x, colour = G.raw("label", "RealNN", True), G.raw("x", "Real"), G.raw("colour", "PickList")
    vector = G.auto_encode([x * 2.0 + 1.0, colour], min_support=1)
    selector = models.binary_selector(["LogisticRegression"], {"LogisticRegression": {"regParam": [0.01, 0.1], "maxIter": [10]}}, folds=2)
    return G.select_model(label, G.sanity_check(label, vector), selector)


@pytest.fixture(scope="module")
def fitted(people, graph):
    return G.Workflow([graph]).train(people)


def test_scores_and_summary(people, fitted):
    out = fitted.score(people)
    assert out.columns == ["key", "prediction"] and out.count() == 120
    assert fitted.evaluate(people, "au_roc") > 0.9 and "LogisticRegression" in fitted.summary()
    assert json.loads(insights.to_json(fitted.insights()))["selected"]["metric"] == "au_pr"


def test_save_load_and_local(spark, people, fitted, tmp_path):
    fitted.save(spark, str(tmp_path / "m"))
    loaded = G.WorkflowModel.load(spark, str(tmp_path / "m"))
    want = {r["key"]: r["prediction"] for r in fitted.score(people).collect()}
    assert {r["key"]: r["prediction"] for r in loaded.score(people).collect()} == want
    local = LocalScorer(loaded)
    for r in people.collect():
        got = local(r.asDict())["prediction"]
        assert all(math.isclose(got[k], want[r["key"]][k], rel_tol=1e-9, abs_tol=1e-9) for k in got)


def test_scoring_without_a_label(people, fitted):
    assert fitted.score(people.drop("label")).count() == 120


def test_warm_start_keeps_stages(people, graph, fitted):
    again = G.Workflow([graph], reuse=fitted).train(people)
    assert [s.model for layer in again.stages for s in layer if s.model] == [s.model for layer in fitted.stages for s in layer if s.model]


def test_filter_drops_and_rewires(people, graph):
    empty = people.withColumn("x", F.lit(None).cast("double"))
    model = G.Workflow([graph], filter_params=drift.FilterParams(min_fill=0.5)).train(empty)
    assert model.filtered["blocked"] == ["x"] and "x" not in model.raw


def test_names_must_differ():
    a = G.raw("x", "Real")
    with pytest.raises(ValueError):
        G.layers([a.apply("abs", name="same"), a.apply("sqrt", name="same")])
    with pytest.raises(AttributeError):
        a.no_such_operator()


def test_runs(spark, people, graph, tmp_path):
    at = lambda n: str(tmp_path / n)
    seen = []
    runner = Runner(G.Workflow([graph]), lambda s, p: people, on_end=[seen.append])
    params = RunParams.parse(json.dumps({"modelLocation": at("m"), "writeLocation": at("w"), "metricsLocation": at("j")}))
    assert runner.run(spark, "train", params)["summary"]["trials"]
    assert runner.run(spark, "score", params)["rows"] == 120 and runner.run(spark, "evaluate", params)["au_pr"] > 0.9
    people.write.parquet(at("in"))
    from featherloom.streaming.scoring import file_stream

    runner.streaming = lambda s, p: file_stream(s, at("in"), people.schema)
    runner.run(spark, "streaming_score", RunParams(model_location=at("m"), write_location=at("s"), checkpoint_location=at("c")))
    assert {tuple(r) for r in spark.read.parquet(at("s")).select("key", F.col("prediction.prediction")).collect()} == {tuple(r) for r in spark.read.parquet(at("w")).select("key", F.col("prediction.prediction")).collect()}
    assert main(runner, ["--run-type", "features", "--write-location", at("f")], spark)["rows"] == 120 and len(seen) == 5
    with pytest.raises(ValueError):
        RunParams.parse('{"nonsense": 1}')
    assert "binary_selector" in generate_project(people, "label", "key", "demo")


def test_encoders_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([], "a double, b string, c array<string>, m map<string,double>, t map<string,string>")
    out = V.encode(df, V.auto_encode(df, hashes=8))
    assert out.count() == 0
    nulls = spark.createDataFrame([(None,) * 5], df.schema)
    encoders = V.auto_encode(nulls, hashes=8)
    assert [s["name"] for s in V.encode(nulls, encoders).schema["features"].metadata["slots"]][:2]
    again = [V.Encoder(**json.loads(json.dumps(e.to_json()))) for e in encoders]
    assert V.encode(nulls, again).first()["features"] == V.encode(nulls, encoders).first()["features"]


def test_pivot_ties_and_unseen(spark):
    df = spark.createDataFrame([(v,) for v in ("b", "a", "b", "a", "c")], "v string")
    e = V.fit(df, "pivot", ["v"], "PickList", top_k=2, min_support=2, clean=False)
    assert e.state["top"]["v"] == ["a", "b"]
    new = spark.createDataFrame([("z",), (None,)], "v string")
    assert [r["features"] for r in V.encode(new, [e]).collect()] == [[0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]


def test_tree_buckets(spark):
    df = spark.createDataFrame([(float(i), float(i > 50)) for i in range(100)] + [(None, 1.0)], "x double, label double")
    e = V.fit(df, "tree", ["x"], "Real", label="label")
    assert len(e.state["splits"]["x"]) >= 1 and V.encode(df, [e]).where("x is null").first()["features"][-1] == 1.0
    flat = df.withColumn("label", F.lit(1.0))
    assert V.fit(flat, "tree", ["x"], "Real", label="label").state["splits"]["x"] == []


def test_isotonic_never_falls(spark):
    df = spark.createDataFrame([(float(i), float((i * 7) % 10 < i / 10)) for i in range(100)], "s double, y double")
    fitted = scalers.fit_isotonic(df, F.col("s"), F.col("y"))
    got = [r[0] for r in df.orderBy("s").select(scalers.calibrate(F.col("s"), fitted)).collect()]
    assert got == sorted(got)


def test_labels_unseen(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    labels = scalers.fit_labels(df, F.col("v"))
    new = spark.createDataFrame([("z",)], "v string")
    assert new.select(scalers.index_labels(F.col("v"), labels), scalers.index_labels(F.col("v"), labels, "skip")).first() == (2.0, None)
    assert new.select(scalers.label_at(F.lit(9.0), labels)).first()[0] == "UnseenIndex"


def test_curves_by_rank_sum(spark):
    rows = [(float(i % 2), ((i * 37) % 101) / 101 + 0.3 * (i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "y double, s double").withColumn("p", (F.col("s") > 0.5).cast("double"))
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for y, a in rows if y for z, b in rows if not z]
    assert math.isclose(evaluators.binary(df, "y", "p", "s", bins=200)["au_roc"], sum(pairs) / len(pairs))
    assert evaluators.binary(df.limit(0), "y", "p", "s")["f1"] == 0.0


def test_thresholds_multi_by_hand(spark):
    data = [(0, [0.5, 0.3, 0.2]), (1, [0.5, 0.3, 0.2]), (2, [0.1, 0.1, 0.8]), (7, [0.4, 0.4, 0.2])]
    df = spark.createDataFrame(data, "label int, probability array<double>")
    for r in evaluators.thresholds_multi(df, top_ns=(1, 2), thresholds=[0.0, 0.4, 0.7]):
        right = wrong = 0
        for y, p in data:
            best = sorted(range(3), key=lambda i: (-p[i], i))[: r["top_n"]]
            mine = p[y] if y < 3 else 0.0
            ok = y in best and mine >= r["threshold"]
            right += ok
            wrong += not ok and max(p) >= r["threshold"]
        assert (r["correct"], r["incorrect"], r["no_prediction"]) == (right, wrong, 4 - right - wrong)


def test_balance_and_sampling(spark):
    df = spark.createDataFrame([(i, int(i < 20)) for i in range(1000)], "k int, y int")
    out, info = splitters.DataBalancer(fraction=0.2).prepare(df, F.col("k"), "y")
    n = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert info["up"] >= 2 and abs(n[1] / (n[0] + n[1]) - 0.2) < 0.06
    same, info = splitters.DataBalancer(fraction=0.01).prepare(df, F.col("k"), "y")
    assert same.count() == 1000 and info["up"] == 0.0


def test_random_grids():
    got = models.RandomParams(1).uniform("a", 1, 5).exponential("b", 1e-4, 1e-1).subset("c", ["x", "y"]).build(20)
    assert len(got) == 20 and all(1 <= g["a"] <= 5 and 1e-4 <= g["b"] <= 1e-1 and g["c"] in "xy" for g in got)
    assert len(models.grid("LogisticRegression")) == 8 and len(models.grid("RandomForestClassifier")) == 18


def test_sanity_check_removes_leaks(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 2), 1.0, float(i)) for i in range(200)], "y double, leak double, flat double, fine double")
    vector = V.encode(df, [V.fit(df, "numeric", ["leak", "flat", "fine"], "Real", track_nulls=False)])
    found, keep = quality.sanity_check(vector, "features", "y", quality.CheckParams(remove_bad=True))
    assert keep == [2] and found[0].reasons and found[1].reasons == ["variance"]
    ranks, _ = quality.sanity_check(vector, "features", "y", quality.CheckParams(correlation="spearman"))
    assert abs(ranks[0].correlation - 1) < 1e-9


def test_means_do_not_drift(spark):
    columns = [[float(i * 7919 % 50 + 1) for i in range(60000)], [(i * 7919 % 11) / 100 for i in range(60000)], [float(i * 7919 % 101 - 49) for i in range(60000)], [0.0] * 60000, [1e300] * 60000]
    df = spark.createDataFrame([(list(x), float(i % 2)) for i, x in enumerate(zip(*columns, strict=True))], "v array<double>, y double").coalesce(1)
    got = quality.moments(df, "v", "y", 5, label_only=True).mean
    assert got[0] == sum(columns[0]) / 60000 and got[2] == sum(columns[2]) / 60000 and got[3] == 0 and got[5] == 0.5
    assert abs(got[1] - math.fsum(columns[1]) / 60000) <= math.ulp(got[1])
    assert math.isclose(got[4], 1e300)


def test_table_layout():
    assert insights.ascii_table(["a"], [["long"]], align="right").splitlines()[1] == "|    a |"


def test_failing_candidates_are_left_out(spark, people):
    vectors = V.encode(people, [V.fit(people, "numeric", ["x"], "Real")])
    data = models.ready(vectors, "features", "label")
    good = [("LogisticRegression", [{"maxIter": 5}]), ("NaiveBayes", [{"smoothing": -1.0}])]
    trials = models.validate(data, "features", F.col("key"), good, "au_roc", models.Validation(folds=2))
    assert [t.model for t in trials] == ["LogisticRegression"]
    with pytest.raises(RuntimeError):
        models.validate(data, "features", F.col("key"), good[1:], "au_roc", models.Validation(folds=2))


def test_mixed_predictions(spark):
    df = spark.createDataFrame([({"prediction": 0.0, "probability_0": 0.6, "probability_1": 0.4}, {"prediction": 1.0, "probability_0": 0.1, "probability_1": 0.9})], "a map<string,double>, b map<string,double>")
    assert models.combine(df, "a", "b").first()["prediction"]["prediction"] == 1.0
    assert models.combine(df, "a", "b", (1, 0)).first()["prediction"]["prediction"] == 0.0


def test_local_learners_score_as_spark_does(spark):
    from featherloom.plans.local import scorer_of

    rows = [([float(i % 7), float((i * 5) % 11), float(i % 3)], float((i % 7) + (i * 5) % 11 > 8), float(i % 3), 1.0 + (i % 7) * 2 + i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "v array<double>, two double, three double, line double")
    made = {n: ({}, "two") for n in ("LogisticRegression", "DecisionTreeClassifier", "RandomForestClassifier", "GBTClassifier", "LinearSVC", "NaiveBayes")}
    made |= {n: ({}, "line") for n in ("LinearRegression", "DecisionTreeRegressor", "RandomForestRegressor", "GBTRegressor", "GeneralizedLinearRegression")}
    cases = [(n, *c) for n, c in made.items()] + [("LogisticRegression", {}, "three"), ("NaiveBayes", {"modelType": "gaussian"}, "three"), ("RandomForestClassifier", {"numTrees": 3}, "three"), ("GeneralizedLinearRegression", {"family": "poisson"}, "line")]
    for name, params, label in cases:
        model = models.fit(name, params, models.ready(df, "v", label))
        local = scorer_of(model)
        for r in models.predict(model, df, "v").collect():
            got = local(r["v"])
            assert got.keys() == r["prediction"].keys(), name
            assert all(math.isclose(got[k], r["prediction"][k], rel_tol=1e-7, abs_tol=1e-9) for k in got), (name, params, got, r["prediction"])


def test_local_encoders_encode_as_spark_does(spark):
    from featherloom.plans.local import _encoder

    rows = [(float(i), ["a b", "The c", None, "d-e é"][i % 4], ["x", "y"][: i % 3] if i % 5 else None, 86_400_000 * i if i % 4 else None, [1.0 * i, 2.0, 3.0] if i % 3 else None, {"k": 1.0 * i, "l": None}, {"p": "u v"} if i % 2 else {"q": "w"}, float(i > 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "n double, t string, s array<string>, d long, g array<double>, m map<string,double>, p map<string,string>, y double")
    encoders = [
        V.fit(df, "numeric", ["n"], "Real"), V.fit(df, "pivot", ["t"], "PickList", min_support=1), V.fit(df, "pivot", ["s"], "MultiPickList", min_support=1, top_k=1), V.fit(df, "hash", ["t"], "Text", hashes=16),
        V.fit(df, "hash", ["s"], "TextList", hashes=8), V.fit(df, "smart_text", ["t"], "Text", max_cardinality=1, coverage=1.1, hashes=8), V.fit(df, "days", ["d"], "Date", reference_ms=10_000_000_000), V.fit(df, "location", ["g"], "Geolocation"),
        V.fit(df, "map_values", ["m"], "RealMap", fill="mean"), V.fit(df, "map_pivot", ["p"], "PickListMap", min_support=1), V.fit(df, "tree", ["n"], "Real", label="y"),
    ]
    for e in encoders:
        for r in V.encode(df, [e]).collect():
            assert _encoder(e.to_json(), r.asDict()) == pytest.approx(list(r["features"])), (e.kind, r)


def test_models_score_after_an_observation(spark):
    """An observation makes the session's manager of observations, which no task can be sent."""
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    df = spark.createDataFrame([([float(i), float(i % 3)], float(i > 10), 2.0 * i) for i in range(40)], "v array<double>, y double, z double")
    for name in (*models.CLASSIFIERS, *models.REGRESSORS):
        params = {"layers": [2, 2], "maxIter": 5} if name.startswith("Multilayer") else {}
        model = models.fit(name, params, models.ready(df, "v", "y" if name in models.CLASSIFIERS else "z"))
        assert models.predict(model, df, "v").where(F.element_at("prediction", F.lit("prediction")).isNotNull()).count() == 40
