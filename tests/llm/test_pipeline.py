"""The stages, one after the other, against plain versions of them."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from featherloom.llm import langid
from featherloom.llm.queries import tokenizer_path
from tests.conftest import SMALL
from tests.llm.brute import distances, grams, near_groups, overlap, profile, redacted
from tests.llm.test_packing import valid


def test_stages_and_run(spark, documents):
    rows = [r.asDict() for r in documents.collect()]
    counts: dict[str, Counter] = {}
    for r in rows:
        counts.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    profiles = {k: profile(c, langid.PROFILE) for k, c in counts.items()}
    near = lambda t: min((distances(t, profiles, langid.PROFILE) or {"": 2.0}).values())
    kept = [r for r in rows if near(r["text"]) <= corpus_pipeline.MAX_DISTANCE]
    groups = near_groups({r["doc_id"]: r["text"] for r in kept}, 80)
    kept = [r for r in kept if groups[r["doc_id"]] == r["doc_id"]]
    items = {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    kept = [r for r in kept if not overlap(r["text"], items)[2]]
    texts = {r["doc_id"]: redacted(r["text"]) for r in kept}

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = set()
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        want |= {(i, k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    valid(got, 4096)
    assert 0 < len(kept) < len(rows)


def test_stages_return_documents(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "scan_secrets", "pack"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents.limit(20), SMALL).columns == documents.columns


def test_one_quoted_item_is_enough_to_go(spark, documents, table):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    left = corpus_pipeline.decontaminate(spark, table(f"before {item} after", "nothing of a benchmark"), SMALL)
    assert [r["doc_id"] for r in left.collect()] == [1]
    items = {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = {r["doc_id"] for r in documents.collect() if not overlap(r["text"], items)[2]}
    got = corpus_pipeline.decontaminate(spark, documents, SMALL)
    assert {r["doc_id"] for r in got.collect()} == want and len(want) < documents.count()


def test_near_duplicates_from_a_similarity_of_four_fifths(spark, table):
    """12 of 15 shingles in common (exactly 0.8), 140 of 170 (0.82) and 158 of 200 (0.79)."""
    w = lambda p, n: [f"{p}{i}" for i in range(n)]
    pair = lambda p, common, a, b: [" ".join([*w(p, common + 4), *w(f"{p}x", a)]), " ".join([*w(p, common + 4), *w(f"{p}y", b)])]
    texts = [*pair("p", 12, 2, 1), *pair("q", 140, 15, 15), *pair("r", 158, 21, 21)]
    left = corpus_pipeline.near_dedup(spark, table(*texts), SMALL)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2, 4, 5]
