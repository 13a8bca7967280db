"""Edges of scalar functions: nulls, infinities, rounding, ties, empty collections; random values against plain Python."""

import math as m

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from featherloom.functions import collections as K
from featherloom.functions import dates, math, net, text
from featherloom.plans.local import LOCAL


def one(spark, schema, values, *cols):
    return tuple(spark.createDataFrame([values], schema).select(*cols).first())


def test_null_arithmetic(spark):
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame([(None, None), (None, 2.0), (3.0, None), (3.0, 0.0)], "a double, b double")
    got = [tuple(r) for r in df.select(math.add(a, b), math.subtract(a, b), math.multiply(a, b), math.divide(a, b)).collect()]
    assert got == [(None,) * 4, (2.0, -2.0, None, None), (3.0, 3.0, None, None), (3.0, 3.0, 0.0, None)]


def test_not_finite_is_null(spark):
    c = F.col("x")
    got = one(spark, "x double", (1e308,), math.multiply_scalar(c, 10), math.exp(c), math.sqrt(-c), math.log(-c, 10), math.power(c, 2), math.round_half_up(F.lit(-2.5)))
    assert got == (None, None, None, None, None, -2)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aé B9.-_!z ", max_size=12), min_size=1, max_size=20))
def test_clean_as_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert [r[0] for r in df.select(text.clean(F.col("s"))).collect()] == [LOCAL["clean"](v) for v in values]


def test_bucket_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 5.0, -1.0, 9.0, None)], "x double")
    left = [r[0] for r in df.select(math.bucket_index(F.col("x"), [0, 1, 2, 5])).collect()]
    right = [r[0] for r in df.select(math.bucket_index(F.col("x"), [0, 1, 2, 5], False)).collect()]
    assert left == [0, 1, 2, 2, None, None, None] and right == [0, 0, 1, 2, None, None, None]
    with pytest.raises(ValueError):
        math.bucket_index(F.col("x"), [0, 0, 1])


def test_jaccard_and_ngrams(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, "a array<string>, b array<string>", ([], None), text.jaccard(a, b)) == (1.0,)
    assert one(spark, "a array<string>, b array<string>", (["x", "y"], ["y"]), text.jaccard(a, b), text.ngrams(b, 2), text.set_ngram_similarity(b, b)) == (0.5, None, 1.0)
    assert text.ngram_distance("", "a") == 0.0 and text.ngram_distance("kitten", "kitten") == 1.0 and 0 < text.ngram_distance("kitten", "mitten") < 1


def test_week_numbers(spark):
    # 1 January 2024 is a Monday; so is 31 December 2012, in the 54th week of a leap year that began on a Sunday
    ms = [1_704_067_200_000, 1_356_912_000_000]
    df = spark.createDataFrame([(x,) for x in ms], "t long")
    got = [tuple(r) for r in df.select(dates.time_period(F.col("t"), "WeekOfYear"), dates.time_period(F.col("t"), "DayOfWeek")).collect()]
    assert got == [(1, 1), (54, 1)]


def test_days_toward_zero(spark):
    assert one(spark, "t long", (1,), dates.days_between(F.col("t"), 0), dates.days_between(F.col("t"), dates.DAY_MS)) == (0, 0)


def test_mode_of_dates_ties_to_smallest(spark):
    assert one(spark, "x array<int>", ([3, 1, 3, 1, 2],), dates.most_frequent(F.col("x"))) == (1,)


def test_net(spark):
    df = spark.createDataFrame([(s,) for s in ("a@b.co", "a@@b.co", "nobody", None)], "s string")
    assert [tuple(r) for r in df.select(net.email_prefix(F.col("s")), net.email_domain(F.col("s")), net.is_valid_email(F.col("s"))).collect()] == [("a", "b.co", True), (None, None, False), (None, None, False), (None, None, None)]
    assert one(spark, "s string", ("+1 212 555 0123",), net.parse_phone(F.col("s"))) == ("+12125550123",)
    assert one(spark, "s string", ("1",), net.is_valid_phone(F.col("s"))) == (None,)
    assert one(spark, "s string", ("not base64!",), net.base64_text(F.col("s")), net.mime_type(F.col("s"))) == (None, None)


def test_collections(spark):
    c = F.col("m")
    got = one(spark, "m map<string,double>", ({"b": 1.0, "a": 1.0, "c": 3.0},), K.top_n_map(c, 2), K.filter_map(c, allow=["x"]), K.filter_map(c, block=["a"]))
    assert got == ({"c": 3.0, "a": 1.0}, None, {"b": 1.0, "c": 3.0})
    parts = one(spark, "p map<string,double>", ({"prediction": 1.0, "probability_1": 0.9, "probability_0": 0.1},), *K.prediction_parts(F.col("p")))
    assert parts == (1.0, [], [0.1, 0.9])
    assert one(spark, "x int", (None,), K.occurs(F.col("x"), "number"), K.replace_value(F.col("x"), None, 4)) == (0.0, 4)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(-1e6, 1e6)), st.one_of(st.none(), st.floats(-1e6, 1e6))), min_size=1, max_size=20))
def test_arithmetic_as_local(spark, pairs):
    df = spark.createDataFrame(pairs, "a double, b double")
    a, b = F.col("a"), F.col("b")
    for name, fn in (("plus", math.add), ("minus", math.subtract), ("times", math.multiply), ("divided_by", math.divide)):
        for r, (x, y) in zip(df.select(fn(a, b)).collect(), pairs, strict=True):
            want = LOCAL[name](x, y)
            assert (r[0] is None) == (want is None) and (want is None or m.isclose(r[0], want, rel_tol=1e-12, abs_tol=1e-300))


def plain_ngram_similarity(a: str, b: str, n: int) -> float:
    """Kondrak's recurrence, cell by cell; n - 1 zeros stand before both texts and are equal for nothing."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if min(len(a), len(b)) < n:
        return sum(p == q for p, q in zip(a, b, strict=False)) / max(len(a), len(b))
    x, y = "\0" * (n - 1) + a, "\0" * (n - 1) + b
    d = {(i, 0): float(i) for i in range(len(a) + 1)} | {(0, j): float(j) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            pairs = [(p, q) for p, q in zip(x[i - 1 : i - 1 + n], y[j - 1 : j - 1 + n], strict=True) if not p == q == "\0"]
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + sum(p != q for p, q in pairs) / len(pairs))
    return 1.0 - d[len(a), len(b)] / max(len(a), len(b))


def test_ngram_scores_against_a_plain_version():
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 30])))
    for n in (2, 3, 4):
        a, b = [word() for _ in range(300)], [word() for _ in range(300)]
        got = text.ngram_scores(a, b, n)
        assert all(abs(g - plain_ngram_similarity(x, y, n)) < 1e-12 for g, x, y in zip(got, a, b, strict=True))
