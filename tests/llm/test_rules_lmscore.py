import math

import pytest

from featherloom.llm import lmscore, rules


def test_measures():
    text = "a b c\na b c\n\n# x y é\n"
    assert rules.measure(text) == (9, 11, 1, 1, 6)
    assert rules.measure(None) == rules.measure("") == (0, 0, 0, 0, 0)
    assert rules.repeated_words([b"a"] * 5) == 5 and rules.repeated_words([b"a", b"b"]) == 0


def test_hosts_take_their_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good if i % 10 else bad, "good") for i in range(40)] + [(100 + i, bad if i % 10 else good, "bad") for i in range(40)] + [(200, good, None), (201, None, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'clash' as kept", "1 as n_words")
    out = {r["doc_id"]: r for r in rules.judge(df).collect()}
    assert len(out) == 82 and out[1]["kept"] and not out[0]["kept"] and not out[100]["kept"] and not out[100]["base_failed"]
    assert out[200]["kept"] and out[200]["shrunk_rate"] is None and 0 < out[201]["shrunk_rate"] < 1
    assert rules.judge(df.limit(0)).count() == 0


def test_shrinkage_by_hand(spark):
    rows = [("a", True)] * 9 + [("a", False)] + [("b", False)] * 10
    df = spark.createDataFrame(rows, "h string, f boolean")
    got = {r["host"]: r["shrunk_rate"] for r in rules.host_verdicts(df, "h", "f").collect()}
    between = (10 * (0.9 - 0.45) ** 2 * 2 - 0.45 * 0.55) / (20 - 200 / 20)
    w = min(max(0.45 * 0.55 / between - 1, 1.0), 10)
    assert got == pytest.approx({"a": (9 + 0.45 * w) / (10 + w), "b": 0.45 * w / (10 + w)})


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "A c"), (3, None), (4, "a b")], "doc_id long, text string")
    target = spark.createDataFrame([(1,), (1,), (9,), (None,)], "doc_id long")
    out = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(df, target).collect()}
    # document 2 without itself: corpus "a b", "a b"; target "a b"; vocabulary of 3 words
    b = -(math.log((2 + 4 * 2.5 / 6) / 6) + math.log((0 + 4 * 0.5 / 6) / 6)) / 2
    t = -(math.log((1 + 4 * 1.5 / 4) / 5) + math.log((0 + 4 * 0.5 / 4) / 5)) / 2
    assert out[2]["loss_background"] == pytest.approx(b) and out[2]["loss_target"] == pytest.approx(t) and out[2]["score"] == pytest.approx(t - b)
    assert out[3]["score"] is None and out[3]["n_words"] == 0
    assert lmscore.cross_entropy_difference(df.limit(0), target).count() == 0


def test_repeated_rows_and_no_target(spark):
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "x")], "doc_id long, text string").selectExpr("*", "'clash' as n_words", "2 as target")
    out = lmscore.cross_entropy_difference(df, df.select("doc_id").limit(0)).collect()
    assert len(out) == 3 and len({r["score"] for r in out if r["doc_id"] == 1}) == 1


def test_distinct_against_numpy():
    import numpy as np

    rng = np.random.default_rng(1)
    for codes in (np.empty(0, np.uint64), rng.integers(0, 5, 1).astype(np.uint64), rng.integers(0, 40, 999).astype(np.uint64), rng.integers(0, 1 << 64, 500, np.uint64)):
        for got, want in zip(lmscore.distinct(codes), np.unique(codes, return_inverse=True, return_counts=True), strict=True):
            assert got.tolist() == want.tolist()
