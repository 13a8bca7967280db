"""Aggregators and readers at the edges: cut-offs, windows, ties, keys without events that count."""

import pytest
from pyspark.sql import functions as F

from featherloom.operators.aggregators import AGGREGATORS
from featherloom.operators.events import DAY_MS, Conditional, CutOff, EventFeature, aggregate_events, conditional_events
from featherloom.operators.joins import JoinedFeature, join_keyed, window_after_join
from featherloom.operators.aggregators import total
from featherloom.sources import readers
from featherloom.types import TYPES, infer

EVENTS = "k string, t long, i long, v double, s string, m map<string,double>"


def events(spark, *rows):
    return spark.createDataFrame([r + (None,) * (6 - len(r)) for r in rows], EVENTS)


def agg(spark, df, *features, cut=100, **more):
    out = aggregate_events(df, F.col("k"), F.col("t"), list(features), CutOff(cut), F.col("i"), **more)
    return {r["key"]: tuple(r[f.name] for f in features) for r in out.collect()}


def test_there_is_an_aggregator_for_every_type():
    assert len(TYPES) == 53 and len(AGGREGATORS) == 185 + 2  # FirstRealNN and LastRealNN besides
    assert all(t.aggregator in AGGREGATORS for t in TYPES.values())


def test_window_edges_are_inside(spark):
    df = events(spark, *[("a", t, i, 1.0) for i, t in enumerate((89, 90, 99, 100, 110, 111))])
    v = F.col("v")
    got = agg(spark, df, EventFeature("p", v), EventFeature("r", v, response=True), EventFeature("w", v, window_ms=1), predictor_window_ms=10, response_window_ms=10)
    assert got == {"a": (2.0, 2.0, 1.0)}


def test_key_without_counting_events_has_a_row(spark):
    df = events(spark, ("a", 500, 0, 1.0, "x", {"q": 1.0}))
    got = agg(spark, df, EventFeature("r", F.col("v")), EventFeature("nn", F.col("v"), "RealNN"), EventFeature("t", F.col("s"), "Text"), EventFeature("m", F.col("m"), "RealMap"))
    assert got == {"a": (None, 0.0, None, None)}


def test_ties_of_first_and_last(spark):
    df = events(spark, ("a", 5, 1, 1.0), ("a", 5, 2, 2.0), ("a", 9, 3, 3.0), ("a", 9, 4, 4.0), ("b", 0, 5, 7.0))
    got = agg(spark, df, EventFeature("f", F.col("v"), "Real", "FirstReal"), EventFeature("l", F.col("v"), "Real", "LastReal"))
    assert got == {"a": (2.0, 3.0), "b": (7.0, None)}  # the last never takes a date at or before the epoch


def test_maps_and_texts(spark):
    df = events(spark, ("a", 1, 1, 1.0, "x", {"p": 1.0, "q": 5.0}), ("a", 2, 2, 1.0, "", {"p": 3.0}), ("a", 3, 3, 1.0, "y", None))
    got = agg(spark, df, EventFeature("s", F.col("m"), "RealMap"), EventFeature("mx", F.col("m"), "RealMap", "UnionMeanRealMap"), EventFeature("t", F.col("s"), "Text"), EventFeature("c", F.col("s"), "Email"))
    assert got == {"a": ({"p": 4.0, "q": 5.0}, {"p": 2.0, "q": 5.0}, "x y", "x,y")}


def test_midpoint(spark):
    df = spark.createDataFrame([("a", [0.0, 179.0, 6.0]), ("a", [0.0, -179.0, 6.0]), ("b", None)], "k string, g array<double>")
    out = {r["key"]: r["g"] for r in aggregate_events(df, F.col("k"), F.lit(1), [EventFeature("g", F.col("g"), "Geolocation")]).collect()}
    assert out["b"] is None and abs(abs(out["a"][1]) - 180) < 1e-6 and abs(out["a"][0]) < 1e-9 and out["a"][2] == 10.0


def test_conditional(spark):
    df = events(spark, ("a", 10, 1, 1.0), ("a", 20, 2, 2.0, "buy"), ("a", 30, 3, 4.0, "buy"), ("b", 10, 4, 9.0))
    features = [EventFeature("p", F.col("v")), EventFeature("r", F.col("v"), response=True)]
    run = lambda **how: {r["key"]: (r["p"], r["r"]) for r in conditional_events(df, F.col("k"), F.col("t"), features, Conditional(F.col("s") == "buy", **how), F.col("i")).collect()}
    assert run() == {"a": (1.0, 6.0)}
    assert run(keep="max") == {"a": (3.0, 4.0)}
    assert run(drop_unmet=False, now_ms=1000)["b"] == (9.0, None)
    assert run(keep="random", seed=3) == run(keep="random", seed=3)


def test_cut_offs():
    assert CutOff.unix_epoch(-5).at == 0 and CutOff.ddmmyyyy("02011970").at == DAY_MS and CutOff.days_ago(1, 3 * DAY_MS + 7).at == 2 * DAY_MS and CutOff.weeks_ago(1, 8 * DAY_MS).at == DAY_MS


def test_window_after_join_leaves_edges_out(spark):
    df = spark.createDataFrame([("a", 100, t, 1.0) for t in (90, 91, 99, 100, 109, 110)] + [("b", 100, None, 1.0)], "k string, cut long, t long, v double")
    out = window_after_join(df, "k", F.col("cut"), F.col("t"), [JoinedFeature("p", F.col("v"), total), JoinedFeature("r", F.col("v"), total, response=True)], 10)
    assert {r["k"]: (r["p"], r["r"]) for r in out.collect()} == {"a": (2.0, 2.0), "b": (None, None)}


def test_join_keys(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "key string, a int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "key string, b int")
    assert sorted(tuple(r) for r in join_keyed(a, b, "outer").collect()) == [("x", 1, None), ("y", 2, 3), ("z", None, 4)]
    with pytest.raises(ValueError):
        join_keyed(a, b, "cross")
    one = readers.frame(a, F.col("key"), name="same")
    with pytest.raises(ValueError):
        one.join(readers.frame(b, F.col("key"), name="same"))


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,when,n\n1,2020-01-01,5\n2,,\n")
    auto = readers.csv_auto(str(tmp_path / "x.csv"), F.col("id"))
    assert {r["key"]: r["n"] for r in auto.generate(spark, [EventFeature("n", F.col("n"), "Integral")]).collect()} == {"1": 5, "2": None}
    typed = readers.csv(str(tmp_path / "x.csv"), F.col("id"), "id int, at string, n int", header=True)
    assert typed.read(spark).count() == 2
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    with pytest.raises(Exception):
        readers.cast_columns(df, spark.createDataFrame([], "a int, b int").schema).collect()
    assert tuple(readers.cast_columns(df, spark.createDataFrame([], "a int, b int").schema, strict=False).first()) == (1, None)
    readers.save_with_schema(df.withMetadata("a", {"ftype": "ID"}), str(tmp_path / "t"))
    back = readers.load_with_schema(spark, str(tmp_path / "t"))
    assert infer(back.schema["a"]) == "ID" and readers.read_existing(spark, [str(tmp_path / "none"), str(tmp_path / "t")]).count() == 1
