"""Every feature type at once: random values, default aggregators, default encoders; and the helpers around them."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.functions import text
from featherloom.operators import frames, names
from featherloom.operators import vectorizers as V
from featherloom.operators.events import CutOff, EventFeature, aggregate_events
from featherloom.plans.metrics import stage_metrics
from featherloom.testing.random_data import RandomData, poisson
from featherloom.types import TYPES, infer


@pytest.fixture(scope="module")
def everything(spark):
    n = 40
    data = {t: RandomData(t, seed=i, empty=0.2 if TYPES[t].nullable else 0.0).limit(n) for i, t in enumerate(TYPES)}
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("ts", T.LongType()), *[T.StructField(t, TYPES[t].spark, True, {"ftype": t}) for t in TYPES]])
    return spark.createDataFrame([(str(i % 5), i, *[data[t][i] for t in TYPES]) for i in range(n)], schema)


def test_random_data_repeats():
    a = RandomData("Real", seed=3, empty=0.5)
    first = a.limit(50)
    assert first == a.reset(3).limit(50) and None in first
    assert sum(RandomData("Real", draw=poisson(4)).limit(2000)) / 2000 == pytest.approx(4, abs=0.3)
    with pytest.raises(ValueError):
        RandomData("RealNN", empty=0.1)


def test_default_aggregators_of_all_types(everything):
    features = [EventFeature(t, F.col(t), t) for t in TYPES]
    out = aggregate_events(everything, F.col("key"), F.col("ts"), features, CutOff(30), F.col("ts"))
    assert out.count() == 5 and {f.name: f.dataType for f in out.schema.fields if f.name == "RealMap"}["RealMap"] == T.MapType(T.StringType(), T.DoubleType())
    row = out.where("key = '0'").first()
    want = [r["Real"] for r in everything.where("key = '0' and ts < 30").collect() if r["Real"] is not None]
    assert row["Real"] == pytest.approx(sum(want))


def test_default_encoders_of_all_types(everything):
    own = [t for t in TYPES if t not in ("Prediction", "OPVector")]
    assert [infer(everything.schema[t]) for t in own] == own
    encoders = V.auto_encode(everything, own, min_support=1, hashes=8)
    out = V.encode(everything, encoders)
    slots = out.schema["features"].metadata["slots"]
    assert {s["parent"] for s in slots} == set(own)
    rows = out.select("features").collect()
    assert all(len(r[0]) == len(slots) and all(x is not None for x in r[0]) for r in rows)
    saved = [V.Encoder(**json.loads(json.dumps(e.to_json()))) for e in encoders]
    assert V.encode(everything, saved).select("features").collect() == rows


def test_names(spark):
    rows = [("Mr. John Stone",), ("Reed, Mary",), (None,)] + [(f"John {'x' * (i % 12)}stone",) for i in range(20)]
    df = spark.createDataFrame(rows, "s string")
    fitted = names.detect(df, "s", ["john", "mary", "stone", "reed"], {"john": "Male", "mary": "Female"})
    assert fitted["is_name"]
    stats = df.select(names.name_stats(F.col("s"), json.loads(json.dumps(fitted)))).collect()
    assert stats[2][0] is None and stats[0][0]["Gender"] == "Male"
    plain = spark.createDataFrame([("nothing of the kind",)] * 3, "s string")
    assert not names.detect(plain, "s", ["john"], {})["is_name"]


def test_languages_and_entities(spark):
    df = spark.createDataFrame([("the cat and the dog",), ("der Hund und die Katze",), ("xyz",), (None,)], "s string")
    found = [r[0] for r in df.select(text.detect_languages(F.col("s"), ("en", "de"))).collect()]
    assert found[0]["en"] > found[0].get("de", 0) and found[1]["de"] > found[1].get("en", 0) and found[2] is None and found[3] is None
    e = spark.createDataFrame([("Paid $5 to Acme on 2020-01-02 at 10:30, 7 %",)], "s string").select(text.recognize_entities(F.col("s"), {"Acme": "Organization"})).first()[0]
    assert e == {"$5": ["Money"], "Acme": ["Organization"], "2020-01-02": ["Date"], "10:30": ["Time"], "7 %": ["Percentage"]}


def test_frames(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert frames.holds_for(df.where("x is not null"), F.col("x") > 0) and not frames.holds_for(df, F.col("x") > 0)
    assert frames.holds_for(df, F.col("x") > 1, "any") and frames.holds_for(df, F.col("x") > 5, "none")
    yes, no = frames.split(df, F.col("x") > 1)
    assert (yes.count(), no.count()) == (1, 2)
    seen, counter = frames.counted(df, "rows")
    seen.collect()
    assert counter.get["n"] == 3
    assert [f.name for f in frames.find_fields(df.schema, "X")] == ["x"] and frames.find_fields(df.schema, "qqq") == []
    bins = frames.histogram(df, F.col("x"), 4)
    assert sum(n for _, n in bins) == 2 and frames.density(bins, 0) == 0.0 and frames.density(bins, 9) == 1.0


def test_stage_metrics(spark, tmp_path):
    task = {"Event": "SparkListenerTaskEnd", "Stage ID": 3, "Task Metrics": {"Executor Run Time": 10, "Executor CPU Time": 5_000_000, "JVM GC Time": 1, "Disk Bytes Spilled": 0, "Input Metrics": {"Records Read": 7}, "Shuffle Read Metrics": {"Remote Bytes Read": 1, "Local Bytes Read": 2}, "Shuffle Write Metrics": {"Shuffle Bytes Written": 4}}}
    (tmp_path / "log").write_text("\n".join(json.dumps(x) for x in (task, task, {"Event": "SparkListenerLogStart"})))
    r = stage_metrics(spark, str(tmp_path / "log")).first()
    assert (r["stage"], r["tasks"], r["run_ms"], r["cpu_ms"], r["rows_in"], r["shuffle_read"], r["shuffle_written"]) == (3, 2, 20, 10.0, 14, 6, 8)
