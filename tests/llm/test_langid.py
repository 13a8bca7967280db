from collections import Counter

import pytest
from pyspark.sql import functions as F

from featherloom.llm import langid, queries
from tests.conftest import SMALL
from tests.llm.brute import distances, grams, profile

SIZE = 50


def test_against_brute_force(spark, documents):
    docs = documents.limit(60).cache()
    rows = docs.collect()
    counts: dict[str, Counter] = {}
    for r in rows:
        counts.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    want = {lang: profile(c, SIZE) for lang, c in counts.items()}
    learned = langid.learn_profiles(docs, size=SIZE)
    got = {(r["lang"], r["rank"]): r["gram"] for r in learned.collect()}
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    assert got == {(lang, i): code(g) for lang, p in want.items() for i, g in enumerate(p)}
    for r in langid.identify(docs, learned, size=SIZE).collect():
        d = distances(r["text"], want, SIZE)
        if d is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == min(sorted(d), key=d.get) and r["distance"] == pytest.approx(min(d.values()))


def test_held_out_accuracy(spark):
    folder = SMALL.replace("sf0.001", "sf0.01")
    out = queries.op6_language_id(spark, folder).where("held_out and lang_pred <> 'und'")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("n_chars >= 60").select("doc_id", "lang")
    right = out.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_edges(spark, table):
    learned = langid.learn_profiles(table("the end of the day", "und so weiter"))
    docs = table(None, "", "12 ?!", "the", "the " * 400_000, extra={"score": "clash"})
    out = {r["doc_id"]: r for r in langid.identify(docs, learned).collect()}
    assert [out[i]["lang_pred"] for i in range(5)] == ["und", "und", "und", "en", "en"] and all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["lang_pred"] for r in langid.identify(docs, learned.limit(0)).collect()} == {"und"}
    assert langid.learn_profiles(docs.limit(0)).count() == 0 and langid.identify(docs.limit(0), learned).count() == 0


def test_chunks_do_not_change_counts(monkeypatch):
    text = "Straße ça va, naïve 7 words & more. " * 50
    whole = langid.counts_of(text)
    monkeypatch.setattr(langid, "CHUNK", 64)
    parts = langid.counts_of(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
